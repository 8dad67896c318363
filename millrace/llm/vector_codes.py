"""Vector codes: parts of vectors as the numbers of their nearest codebook entries, in whole numbers.

Vectors are scaled and floored to integers and cut into ``parts`` equal parts.  The codebook of a part
position starts as that part of the first vectors by id; ``rounds`` times every part goes to its nearest
entry and each entry becomes the floored mean of its parts.  All distances and sums are exact integers, so
results depend neither on the partitioning nor on the order of rows.

The nearest entry is found by VA-file filtering.  Entry coordinates are quantised to cells of
``2**CELL_BITS`` ranks, each with the least and greatest coordinate in it.  Per query part, lookup tables
by dimension and cell hold the least and greatest squared difference; their sums over the dimensions
bound the distance of every entry from below and above.  Only entries whose lower bound does not exceed
the least upper bound are refined with integer distances; ties go to the lower number.

On Spark each round is one pass over the vectors with the codebooks in the task closure (256 entries a
part position, so their size depends on the dimension alone); tasks send one row of sums an entry.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; rows that
share an id are told apart by their components, and equal rows all count; null ids come last; fewer rows
than entries give a shorter codebook; null labels count together; vectors of unequal length, of a
length that parts do not divide, or with components beyond 2**28 once scaled raise; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELL_BITS = 5
#: Query parts whose bounds are worked out together.
QUERY_BLOCK = 1024
#: Components beyond this leave no room for exact squared distances in 64 bits.
MAX_COMPONENT = 1 << 28
#: Labels with more than this share of the rows get their sum by broadcast; so there are at most that many.
HOT_LABELS = 1000
#: Groups of tasks among which the first vectors by id are chosen before the last choice.
CHOICE_GROUPS = 256


class VaFile:
    """The entries of one codebook with their cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        """``entries``: (entry, dimension) integers."""
        self.entries = entries.astype(np.int64)
        count, dims = entries.shape
        cells = min(1 << bits, count)
        rank = np.argsort(np.argsort(self.entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // count
        self.low = np.full((dims, cells), np.iinfo(np.int64).max)
        self.high = np.full((dims, cells), np.iinfo(np.int64).min)
        for d in range(dims):
            np.minimum.at(self.low[d], self.cell[:, d], self.entries[:, d])
            np.maximum.at(self.high[d], self.cell[:, d], self.entries[:, d])

    def bounds(self, queries: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, (entry, query)."""
        shape = (len(self.entries), len(queries))
        lower, upper = np.zeros(shape, kind), np.zeros(shape, kind)
        for d in range(queries.shape[1]):
            q = queries[:, d].astype(kind)
            below = self.low[d].astype(kind)[:, None] - q  # above 0: the query lies below the cell
            above = q - self.high[d].astype(kind)[:, None]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)
            far = np.maximum(far, near)
            lower += (near * near)[self.cell[:, d]]
            upper += (far * far)[self.cell[:, d]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per query its entry and the squared distance, and how many distances were refined."""
        if not queries.shape[1]:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), 0
        entry, error, refined = [], [], 0
        most = max(int(np.abs(queries).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int32 if queries.shape[1] * (2 * most) ** 2 < 2**31 else np.int64
        for at in range(0, len(queries), QUERY_BLOCK):
            block = queries[at : at + QUERY_BLOCK].astype(np.int64)
            lower, upper = self.bounds(block, kind)
            row, number = np.nonzero((lower <= upper.min(axis=0)).T)  # by query, then by entry
            distance = np.square(block[row] - self.entries[number]).sum(axis=1)
            begins = np.searchsorted(row, np.arange(len(block)))
            least = np.minimum.reduceat(distance, begins)
            hit = np.flatnonzero(distance == least[row])
            first = hit[np.searchsorted(row[hit], np.arange(len(block)))]
            entry.append(number[first])
            error.append(least)
            refined += len(row)
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(entry or empty), np.concatenate(error or empty), refined


def kept_vectors(batch: pa.RecordBatch, column: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a whole and finite vector, and these vectors as integers (row, component)."""
    vectors = batch.column(column)
    lengths = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float), nan=-1).astype(np.int64)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(np.maximum(lengths, 0))
    keep = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    sizes = np.unique(lengths[keep])
    if len(sizes) > 1:
        raise ValueError(f"vectors of unequal length: {sizes.tolist()}")
    if not keep.any():
        return keep, np.zeros((0, 0), np.int64)
    whole = np.floor(values[np.repeat(keep, np.maximum(lengths, 0))] * scale)
    if np.abs(whole).max(initial=0) > MAX_COMPONENT:
        raise ValueError(f"vector components beyond {MAX_COMPONENT / scale:g}")
    return keep, whole.astype(np.int64).reshape(-1, int(sizes[0]))


def _integers(vectors: np.ndarray) -> pa.Array:
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))


def first_vectors(vectors: DataFrame, count: int, scale: int = SCALE) -> np.ndarray:
    """The ``count`` kept vectors of the smallest ids as integers; at most that many reach the driver.

    Every task passes on ``count`` rows at most, groups of tasks choose among theirs, and the last choice
    sees ``count`` rows of each of CHOICE_GROUPS groups.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = kept_vectors(batch, 1, scale)
            if kept.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), _integers(whole)], names=["vec_id", "whole"])

    order = [F.asc_nulls_last("vec_id"), F.asc("whole")]
    found = vectors.select("vec_id", "vector").mapInArrow(tidy(keep), "vec_id long, whole array<long>")
    found = found.withColumn("grp", F.spark_partition_id() % CHOICE_GROUPS)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("place") <= count)
    rows = found.select("vec_id", "whole").orderBy(*order).limit(count).collect()
    if len({len(r["whole"]) for r in rows}) > 1:
        raise ValueError("vectors of unequal length")
    return np.array([r["whole"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["whole"]) if rows else 0)


def split(vectors: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """Equal consecutive parts of each vector."""
    if vectors.shape[1] % parts:
        raise ValueError(f"vectors of length {vectors.shape[1]} have no {parts} equal parts")
    return np.split(vectors, parts, axis=1)


def _assigned(files: list[VaFile], whole: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per part the entries of the vectors; the squared distances summed over parts."""
    if whole.shape[1] != sum(f.entries.shape[1] for f in files):
        raise ValueError("vectors of unequal length")
    found = [f.nearest(x) for f, x in zip(files, split(whole, len(files)))]
    return [x[0] for x in found], sum((x[1] for x in found), np.zeros(len(whole), np.int64))


def trained_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One codebook (entry, component) a part position; empty ones for a table without kept vectors.

    ``vectors`` has vec_id and vector.
    """
    first = first_vectors(vectors, entries, scale)
    if not len(first):
        return [np.zeros((0, 0), np.int64)] * parts
    books = split(first, parts)
    width = books[0].shape[1]
    names = ["part", "entry", "n", *[f"s{k}" for k in range(width)]]
    schema = ", ".join(f"{c} long" for c in names)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            files = [VaFile(b) for b in books]
            total = np.zeros((parts, len(books[0]), width + 1), np.int64)
            for batch in batches:
                _, whole = kept_vectors(batch, 0, scale)
                if len(whole):
                    for k, (number, part) in enumerate(zip(_assigned(files, whole)[0], split(whole, parts))):
                        np.add.at(total[k], number, np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1))
            part, entry = np.nonzero(total[:, :, 0])
            columns = [part, entry, *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)

        partial = vectors.select("vector").mapInArrow(tidy(sums), schema)
        merged = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
        books = [b.copy() for b in books]
        for row in merged.collect():  # parts x entries rows at most
            books[row["part"]][row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of the kept rows of ``vectors`` (vec_id, vector, label)."""
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b) for b in books] if len(books[0]) else []
        for batch in batches:
            kept, whole = kept_vectors(batch, 1, scale)
            if kept.any():
                numbers, error = _assigned(files, whole)
                code = hexes[numbers[0]]
                for n in numbers[1:]:
                    code = np.char.add(code, hexes[n])
                where = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(where), batch.column(2).filter(where), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    schema = vectors.select("vec_id", "label").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    return vectors.select("vec_id", "vector", "label").mapInArrow(tidy(run), schema)


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector of entries that a code names."""
    return np.concatenate([b[k] for b, k in zip(books, bytes.fromhex(code))])


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors summed over equal labels, nulls together.

    Labels with more than a thousandth of the rows are at most HOT_LABELS and come by broadcast; the rest
    are joined by their label.
    """
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") * HOT_LABELS > rows).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    light = sums.where(F.col("n") * HOT_LABELS <= rows).select(F.col("label").alias("light"), "label_error")
    found = marked.where("hot_error is not null").withColumn("label_error", F.col("hot_error"))
    rest = marked.where("hot_error is null").join(light, F.col("label").eqNullSafe(F.col("light")))
    keep = [*coded.columns, "label_error"]
    return found.select(*keep).unionByName(rest.select(*keep))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks for every kept row."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"), vectors[label_col].alias("label"))
    books = trained_codebooks(rows)
    coded = materialize(encode(rows, books), "vector-codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

