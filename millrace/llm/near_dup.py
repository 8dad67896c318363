"""Near-duplicate groups: banded MinHash candidates, odd-sketch verification, exact confirmation.

1. One pass over the texts makes, per document, its set of five-word shingle hashes, a key of that
   set, MinHash band keys and an odd sketch.  Documents with equal sets form a class; from here on
   one representative stands for each class, so copies are never expanded into pairs.
2. Representatives that share a band bucket are candidates.  In ``STAR_ROUNDS`` rounds each is
   compared with one pivot of its buckets, the one whose odd sketch is nearest; links found there
   join most of every group at a cost linear in its size.
3. What remains is every pair that shares a bucket and is not yet in one component.  All of those
   whose sizes and odd sketches allow the threshold are compared, so no link is lost to step 2.
   Here a second, longer odd sketch of the shingle set itself (for large sets, of the hashes below
   a threshold) estimates the symmetric difference without the MinHash sampling error.
4. Links are confirmed on the full shingle sets.  Components come from alternating large-star and
   small-star rounds.

An odd sketch folds the MinHash samples into a parity bitmap: the XOR of two has
``bits / 2 * (1 - exp(-4 * samples * (1 - J) / bits))`` ones on average, which is steep near J = 1.
The cut leaves five standard deviations at the threshold.  With 24 bands of 6, a pair at 0.85
shares no bucket with a chance of 1e-5.

Defined results: null or blank text has no shingles, links with nothing and stays; with fewer than
five words the whole sequence is the one shingle; a null id takes part in no link and stays; rows
that repeat an id are judged each by its own text, rows that repeat id and text are one class and
``drop_near_copies`` keeps one of them; of equal least ids the lesser text hash stays; a text of any
length is read whole, its set is held by one task at a time; an empty table gives an empty result;
further columns are ignored (kept by ``drop_near_copies``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize, tidy

WORDS = 5
BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
#: The long sketch, and the set size up to which it folds every shingle.
FINE_BITS, FINE_SIZE = 2048, 1500
STAR_ROUNDS = 3
CELL_ROWS = 256
#: Keys below this number are broadcast (24 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_MASK = (1 << 64) - 1


def _numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers by the splitmix64 rule."""
    out = []
    for k in range(1, n + 1):
        z = (seed + k * 0x9E3779B97F4A7C15) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


_PLACE = _numbers(WORDS + 1, 1)
_MULTIPLY = (_numbers(SAMPLES, 2) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_FLIP = (_numbers(SAMPLES, 3) >> np.uint64(32)).astype(np.uint32)[:, None]
_FOLD = _numbers(SAMPLES, 4)
_IN_BAND = _numbers(ROWS, 5)
_BAND = _numbers(BANDS, 6)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; bytes.lower and bytes.split are ASCII-only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mixed((h * _PLACE[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS:] * np.uint64(len(h)))
    n = len(h) - WORDS + 1
    s = h[:n] * _PLACE[0]
    for k in range(1, WORDS):
        s += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(s))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit minima."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(least, ((h[at : at + 4096] ^ _FLIP) * _MULTIPLY).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _IN_BAND).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as SKETCH_BITS / 64 numbers."""
    at = _mixed(samples.astype(np.uint64) * _FOLD + _FOLD) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, parity bitmap): the hashes below 4**-level of the range, folded by their low bits."""
    level = max(0, ceil(log(len(shingles) / FINE_SIZE, 4)))
    kept = shingles[: np.searchsorted(shingles, np.uint64(_MASK >> (2 * level)), side="right")]
    odd = np.bincount((kept % np.uint64(FINE_BITS)).astype(np.int64), minlength=FINE_BITS) & 1
    return level, np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_cut(threshold: float) -> int:
    """The most differing bits that a pair at ``threshold`` shows, five standard deviations above the mean."""
    flips = 2 * SAMPLES * (1 - threshold)
    stays = exp(-2 * flips / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - stays)
    sampling = 2 * (SAMPLES * threshold * (1 - threshold)) ** 0.5 * stays
    parity = (SKETCH_BITS / 4 * (1 - stays**2)) ** 0.5
    return int(mean + 5 * (sampling**2 + parity**2) ** 0.5)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, text: ids may repeat, so a row is told by its id and its text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, bands, sketch; the last three null without shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, odd = [], [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                if len(shingles):
                    samples = minhash(shingles)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(band_keys(samples))
                    odd.append(odd_sketch(samples))
                else:
                    keys.append(None)
                    bands.append(None)
                    odd.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"],
            )

    return _keyed(docs, id_col, text_col).mapInArrow(
        tidy(make), "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
    )


def _shingles_of(docs: DataFrame, owners: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, shingles, level, fine), one row for each of ``owners`` (id, doc_id, text_hash).

    repeated: (doc_id, text_hash) of rows that occur more than once; of these one is taken, chosen
    on the map side.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            folded = [fine_sketch(s) if len(s) else (0, np.zeros(FINE_BITS // 64, np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x for x, _ in folded], pa.int32()), pa.array([y for _, y in folded], pa.list_(pa.int64()))],
                names=["id", "shingles", "level", "fine"],
            )

    key = ["doc_id", "text_hash"]
    small = lambda table: F.broadcast(table) if table.count() <= BROADCAST_IDS else table
    again = materialize(owners.join(repeated, key), "repeated-owners")
    single = docs.join(small(owners.join(again, key, "left_anti")), key).select("id", "text")
    several = docs.join(small(again), key).groupBy("id").agg(F.min("text").alias("text"))
    return single.unionByName(several).mapInArrow(tidy(make), "id long, shingles binary, level int, fine array<long>")


def _ends(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Add the columns of ``table`` for both ends of the pairs (a, b), prefixed by the end."""
    for end in ("a", "b"):
        side = table.select(F.col("id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(side, F.col(end) == F.col(f"{end}_id")).drop(f"{end}_id")
    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * |A & B| >= threshold * |A | B|."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold_percent * (len(x) + len(y) - both))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return _ends(pairs, sets, ["shingles"]).select("a", "b", "a_shingles", "b_shingles").mapInArrow(tidy(check), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for ids that have an edge (a, b).

    Large-star and small-star rounds until the edges no longer change, as many as it takes: their
    number grows with the logarithm of the edges, and each round only lowers labels.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = (
            large.join(down, F.col("a") == F.col("u"))
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        now = materialize(small, "stars")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        mark = tuple(new)

def _differing(a: str, b: str, bits: int) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(bits // 64)), F.lit(0))


def _possible(threshold_percent: int) -> Column:
    """What sizes and MinHash odd sketches allow."""
    sizes = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * threshold_percent
    return sizes & (_differing("a_sketch", "b_sketch", SKETCH_BITS) <= sketch_cut(threshold_percent / 100))


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two arrays of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _fine_cut(size: np.ndarray, level: np.ndarray, t: float) -> np.ndarray:
    """The most differing bits of a pair at the threshold.  size: of both sets together.

    Each element of the symmetric difference flips one bit, so where every shingle was folded its
    size is a bound that loses nothing.  For sampled sets: the mean and four and a half standard
    deviations of sample and collisions."""
    n = FINE_BITS
    flips = size * ((1 - t) / (1 + t)) * 0.25**level
    stays = np.exp(-2 * flips / n)
    sampled = n / 2 * (1 - stays) + 4.5 * (np.sqrt(2 * flips * flips / n + flips) * stays + 1)
    return np.where(level == 0, flips + 1e-6, sampled)


def cell_pairs(members: DataFrame, threshold_percent: int) -> DataFrame:
    """(a, b), a > b: members of a cell in different components that sizes and sketches allow to link.

    members: bucket, low, high, block, id, component, size, level, sketch, fine.  A cell (bucket,
    low, high) holds one or two blocks of a bucket's members, some CELL_ROWS each, so that no task
    holds a whole bucket; rows come sorted by cell, and only one cell is held at a time.
    """
    t = threshold_percent / 100
    cut = sketch_cut(t)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            bucket, low, high, block, name, component, size, level = (table.column(k).to_numpy() for k in range(8))
            words = lambda k, n: table.column(k).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, n)
            sketch, fine = words(8, SKETCH_BITS // 64), words(9, FINE_BITS // 64)
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
            after = np.append(starts[1:], len(bucket))[group] - np.arange(len(bucket)) - 1
            out, at = [], 0
            while at < len(bucket):  # some rows against all later ones of their cell
                upto = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), 200_000)) + at)
                x = np.repeat(np.arange(at, upto), after[at:upto])
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after[at:upto]) - after[at:upto], after[at:upto])
                at = upto
                ok = (component[x] != component[y]) & ((low[x] == high[x]) | (block[x] != block[y]))
                ok &= np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * threshold_percent
                x, y = x[ok], y[ok]
                ok = _ones(sketch[x], sketch[y]) <= cut
                x, y = x[ok], y[ok]
                for k in range(0, len(x), 20_000):
                    u, v = x[k : k + 20_000], y[k : k + 20_000]
                    ok = (level[u] != level[v]) | (_ones(fine[u], fine[v]) <= _fine_cut(size[u] + size[v], level[u], t))
                    out.append(np.stack([np.maximum(name[u[ok]], name[v[ok]]), np.minimum(name[u[ok]], name[v[ok]])]))
            a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = [held.column(k)[-1].as_py() for k in range(3)]
            same = np.logical_and.reduce([held.column(k).to_numpy() == v for k, v in enumerate(last)])
            first = int(np.argmax(same))  # the last cell may go on in the next batch
            if first:
                yield found(held.slice(0, first))
                held = held.slice(first)
        if held is not None and held.num_rows:
            yield found(held)

    return members.mapInArrow(tidy(pairs), "a long, b long").distinct()


def _judged(docs: DataFrame, threshold_percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id and ``first``, the id and text
    hash of the row that stays in its component (both null without shingles or id)."""
    texts = _keyed(docs, id_col, text_col)
    made = materialize(sketches(docs, id_col, text_col), "sketches")
    # one representative per distinct shingle set; copies are combined on the map side.  Classes are
    # numbered as they are written, as ids may repeat.
    linked = made.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        linked.groupBy("set_key")
        .agg(F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch"), F.struct("doc_id", "text_hash")).alias("r"))
        .select(
            "set_key", F.monotonically_increasing_id().alias("id"), F.struct("r.doc_id", "r.text_hash").alias("first"),
            F.col("r.n_shingles").alias("size"), "r.bands", "r.sketch",
        ),
        "classes",
    )
    repeated = linked.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    in_bands = classes.select("id", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialize(in_bands.join(shared, "bucket").select("bucket", "id"), "buckets")
    member_ids = materialize(members.select("id").distinct(), "member-ids")
    owners = classes.join(member_ids, "id", "left_semi").select("id", "first.doc_id", "first.text_hash")
    sets = materialize(_shingles_of(texts, owners, repeated), "shingle-sets")
    faces = classes.select("id", "size", "sketch")

    placed, tried, links, component_of = members.withColumn("component", F.col("id")), [], [], None
    for turn in range(STAR_ROUNDS):
        pivots = placed.groupBy("bucket").agg(
            F.min_by(F.struct("id", "component"), F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi")
        ).where("lo < hi")
        spokes = placed.join(pivots, "bucket").where("component != p.component").select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()
        star = _ends(spokes, faces, ["size", "sketch"]).where(_possible(threshold_percent))
        nearest = star.groupBy("a").agg(F.min_by("b", F.struct(_differing("a_sketch", "b_sketch", SKETCH_BITS), "b")).alias("b"))
        tried.append(materialize(nearest, "star-pairs"))
        links.append(materialize(confirmed(tried[-1], sets, threshold_percent), "star-links"))
        component_of = components(reduce(DataFrame.unionByName, links))
        placed = materialize(
            members.join(component_of, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "placed"
        )
    open_buckets = (
        placed.groupBy("bucket")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo < hi")
        .select("bucket", F.ceil(F.col("n") / CELL_ROWS).alias("blocks"))
    )
    block = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks"))
    cells = (
        placed.join(open_buckets, "bucket")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component")
        .join(faces, "id")
        .join(sets.select("id", "level", "fine"), "id")
        .select("bucket", "low", "high", "block", "id", "component", "size", "level", "sketch", "fine")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    crossing = cell_pairs(cells, threshold_percent)
    done = reduce(DataFrame.unionByName, tried).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = materialize(crossing.join(done, ["a", "b"], "left_anti"), "cross-pairs")
    final = components(reduce(DataFrame.unionByName, [*links, confirmed(rest, sets, threshold_percent)]))

    placed = classes.select("set_key", "id", "first").join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"), "first")
    firsts = placed.groupBy("component").agg(F.min("first").alias("first"))
    owner = placed.select("set_key", "component").join(firsts, "component").select("set_key", "first")
    return made.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(owner, "set_key", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first"
    )


def near_groups(docs: DataFrame, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (whether its id is the component's)."""
    return _judged(docs, threshold_percent, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the least id (then text hash), one
    of equal rows; all columns kept, whatever their names."""
    judged = materialize(_judged(docs, threshold_percent, id_col, text_col), "judged")
    key = ["doc_id", "text_hash"]
    fate = judged.where("first is not null").groupBy(*key, "first").agg(F.count(F.lit(1)).alias("n")).withColumn("stays", F.col("first") == F.struct(*key))
    fate = materialize(fate.where("not stays or n > 1").select(*key, "stays"), "near-copies")
    small = F.broadcast(fate) if fate.count() <= BROADCAST_IDS else fate
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    several = rows.join(small, key).where("stays").groupBy(*key).agg(F.first("row").alias("row"))
    return rows.join(small, key, "left_anti").select("row.*").unionByName(several.select("row.*"))
