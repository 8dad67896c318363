"""Spherical k-means and greedy diversity over vectors, on all rows without one task or the driver seeing them.

Vectors are brought to length one and held as whole numbers (``2**UNIT_BITS`` to one), so sums of a cluster are
exact and centroids do not depend on how rows are partitioned.  Similarities are rounded to nine places; of
equal ones the lower number wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import vectors as vec
from millrace.operators.lineage import checkpointed

UNIT_BITS = 24
#: Centroids beyond this many bytes meet the rows block by block in place of travelling with each task.
BROADCAST_BYTES = 64 << 20
#: Rows stay aside while centroids move by less than this many times the last move, and are left aside only from
#: moves below the second number; what rounded similarities may hide.
AHEAD, NEAR_MOVES, SLACK = 16, 0.005, 1e-8
#: Most rows that one task picks from.
CELL_ROWS = 20_000


def units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors at length one as whole numbers; rows without a vector or of length zero go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            values = [np.asarray(v, float) for v in frame[vector]]
            good = [len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in values]
            whole = [np.rint(v / np.linalg.norm(v) * (1 << UNIT_BITS)).astype(np.int64) for v, g in zip(values, good) if g]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), pa.array(whole, pa.list_(pa.int64()))], names=["key", "unit"])

    kept = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias(vector))
    return kept.mapInArrow(run, "key long, unit array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and similarity of the nearest centroid of each row."""
    products = np.round(_unit(x) @ _unit(centroids).T, 9)
    number = products.argmax(axis=1)
    return number, products[np.arange(len(x)), number]


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, similarity) of ``units`` rows.

    Up to ``BROADCAST_BYTES`` the centroids travel with the tasks; beyond, each block of rows meets each block
    of centroids and the best of the blocks stays.
    """
    if centroids.nbytes > BROADCAST_BYTES:
        made = rows.sparkSession.createDataFrame(pd.DataFrame({"cluster": range(len(centroids)), "centroid": centroids.tolist()}), "cluster long, centroid array<double>")
        found = vec.within(rows, made, -1.0, ("key", "unit"), ("cluster", "centroid"), k=1)
        return found.select("key", "cluster", "similarity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, similarity = nearest(_matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(similarity)], names=["key", "cluster", "similarity"])

    return rows.select("key", "unit").mapInArrow(run, "key long, cluster long, similarity double")


def _sums(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact sums of the rows by their nearest centroid; each task sends a row a cluster at most."""
    k, dims = centroids.shape
    names = ["cluster", *[f"s{d}" for d in range(dims)]]
    if centroids.nbytes > BROADCAST_BYTES:
        joined = assign(rows, centroids).join(rows, "key")
        partial = joined.select("cluster", *[F.col("unit")[d].alias(f"s{d}") for d in range(dims)])
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((k, dims), np.int64), np.zeros(k, bool)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(-1, dims)
                    number = nearest(x.astype(float), centroids)[0]
                    order = np.argsort(number, kind="stable")
                    at, first = np.unique(number[order], return_index=True)
                    total[at] += np.add.reduceat(x[order], first, axis=0)
                    seen[at] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *[pa.array(c) for c in np.ascontiguousarray(total[at].T)]], names=names)

        partial = rows.select("unit").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    out = np.zeros((k, dims), np.int64)
    for row in partial.groupBy("cluster").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect():  # k rows
        out[row["cluster"]] = row[1:]
    return out


def _draw(salt: str) -> Column:
    """A number from 0 to 1 by key and salt."""
    return (F.pmod(F.xxhash64(F.lit(salt), F.col("key")), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def seeds(rows: DataFrame, k: int, seed: int = 0, rounds: int = 5) -> np.ndarray:
    """k-means||: ``rounds`` times each row is drawn with a chance of 2 k times its share of all
    distances to the candidates so far; the candidates (some 2 k a round) are weighed by the rows nearest to
    them, and the driver chooses k of them by weighted k-means++ with the same seed."""
    first = rows.orderBy(_draw(f"{seed}:first"), "key").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = {first[0]["key"]: first[0]["unit"]}
    for r in range(rounds):
        far = assign(rows, np.array(list(found.values()), float)).withColumn("far", F.greatest(1 - F.col("similarity"), F.lit(0.0)))
        total = far.agg(F.sum(F.round(F.col("far") * 1e9).cast("long"))).first()[0]
        if not total:
            break
        drawn = far.where(_draw(f"{seed}:{r}") < 2 * k * F.round(F.col("far") * 1e9) / float(total)).select("key")
        for row in rows.join(drawn, "key", "left_semi").orderBy("key").collect():
            found[row["key"]] = row["unit"]
    names = sorted(found)
    candidates = np.array([found[n] for n in names], float)
    weight = np.zeros(len(names))
    for row in assign(rows, candidates).groupBy("cluster").count().collect():
        weight[row["cluster"]] = row["count"]
    rng, chosen = np.random.default_rng(seed), []
    distance = np.ones(len(names))
    while len(chosen) < min(k, len(names)):
        share = np.cumsum(weight * distance)
        if share[-1] <= 0:  # nothing but copies of the chosen ones is left
            break
        chosen.append(int(np.searchsorted(share, rng.random() * share[-1], "right")))
        distance = np.minimum(distance, np.maximum(1 - np.round(_unit(candidates) @ _unit(candidates[chosen[-1:]]).T, 9)[:, 0], 0))
    return candidates[chosen]


def _undecided(rows: DataFrame, centroids: np.ndarray, margin: float) -> DataFrame:
    """Rows whose nearest centroid is ahead of the next one by less than ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = np.partition(_unit(_matrix(batch.column(1))) @ _unit(centroids).T, -2, axis=1)[:, -2:]
                yield batch.filter(pa.array(two[:, 1] - two[:, 0] < margin))

    return rows.select("key", "unit").mapInArrow(run, "key long, unit array<long>")


def spherical_kmeans(rows: DataFrame, start: np.ndarray, iterations: int | None = None) -> np.ndarray:
    """Centroids (k, dimension) as sums of ``units`` rows, once no sum changes any more.

    A cluster without rows, or whose rows sum to zero, keeps its centroid.  The number of rounds grows with the
    rows, so it has no bound of its own; with ``iterations``, raises where sums still change after as many.
    Rounds that come back to earlier sums (as rounded similarities may tie) end there.

    Late rounds read few rows.  A centroid that moves by d changes the similarity of any row by d at most, so a
    row whose nearest centroid is ahead by more than twice the greatest move keeps its cluster: it stays aside in
    an exact sum until the centroids have moved too far, and the results are those of whole rounds.
    """
    centroids, last, seen = np.asarray(start, float), None, set()
    few = 1 < len(centroids) and centroids.nbytes <= BROADCAST_BYTES
    active, settled, at, margin, moved = rows, 0, None, 0.0, np.inf
    while iterations is None or len(seen) < iterations:
        sums = settled + _sums(active, centroids)
        if last is not None and (np.array_equal(sums, last) or sums.tobytes() in seen):
            return centroids
        seen.add(sums.tobytes())
        if few and active is rows and moved < NEAR_MOVES:
            margin, at = 2 * AHEAD * moved, centroids
            active = checkpointed(_undecided(rows, centroids, margin + SLACK))
            settled = sums - _sums(active, centroids)
        before, centroids, last = centroids, np.where(sums.any(axis=1, keepdims=True), sums, centroids), sums
        moved = np.linalg.norm(_unit(centroids) - _unit(before), axis=1).max(initial=0.0)
        if at is not None and 2 * np.linalg.norm(_unit(centroids) - _unit(at), axis=1).max() > margin:
            active, settled, at = rows, 0, None
    raise RuntimeError(f"no fixed point after {iterations} iterations")


def medoids(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, key, size, similarity): of each cluster the row nearest to its centroid, the lesser key on ties."""
    a = assign(rows, centroids)
    best = F.max_by(F.struct("key", "similarity"), F.struct("similarity", -F.col("key")))
    return a.groupBy("cluster").agg(best.alias("b"), F.count(F.lit(1)).alias("size")).select("cluster", "b.key", "size", "b.similarity")


def pick_diverse(keys: np.ndarray, x: np.ndarray, relevance: np.ndarray, k: int, weight: float, start: np.ndarray) -> np.ndarray:
    """Places of up to k rows, greedily: first the row least like ``start``, more relevant ones preferred by
    ``weight``; then the row of the greatest ``weight * relevance - (1 - weight) * similarity to the chosen``.
    Of equal ones the lesser key."""
    x = _unit(x)
    order = np.argsort(keys, kind="stable")
    x, relevance = x[order], relevance[order]
    held = np.round(x @ (start / max(np.linalg.norm(start), 1e-300)), 9)
    open_, out = np.ones(len(x), bool), []
    while len(out) < min(k, len(x)):
        score = np.where(open_, np.round(weight * relevance - (1 - weight) * held, 9), -np.inf)
        best = int(score.argmax())
        out.append(best)
        open_[best] = False
        near = np.round(x @ x[best], 9)
        held = near if len(out) == 1 else np.maximum(held, near)
    return order[out]


def diverse(rows: DataFrame, k: int, *, weight: float = 0.0, relevance: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(pick, key, similarity): k rows in the order picked, with the similarity to the nearest one before.

    With ``weight`` 0 this is farthest-point selection; otherwise ``relevance`` (key, relevance) counts too.
    Composable core-sets: rows are dealt to cells of ``cell_rows`` by a hash, each cell picks k by the same
    greedy rule, and the picks of all cells are dealt again until they fit one cell, which picks the answer.
    For distances the result is within a constant of the best, as of the greedy rule over all rows.
    """
    if k * 2 > cell_rows:
        raise ValueError(f"k = {k} needs cells of more than {cell_rows} rows")
    start = _sums_of_all(rows)
    if relevance is None:
        rows = rows.withColumn("relevance", F.lit(0.0))
    else:
        rows = rows.join(relevance, "key", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    rows = rows.select("key", "unit", "relevance")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        places = pick_diverse(frame["key"].to_numpy(), np.stack(frame["unit"]).astype(float), frame["relevance"].to_numpy(), k, weight, start)
        return frame.iloc[places][["key", "unit", "relevance"]]

    n, level = rows.count(), 0
    while n > cell_rows:
        cells = -(-n // cell_rows)
        cell = F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(cells))
        rows = checkpointed(rows.withColumn("cell", cell).groupBy("cell").applyInPandas(choose, "key long, unit array<long>, relevance double"))
        n, level = rows.count(), level + 1

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(frame["unit"]).astype(float))
        places = pick_diverse(frame["key"].to_numpy(), x, frame["relevance"].to_numpy(), k, weight, start)
        near = [None] + [float(np.round(x[p] @ x[places[:i]].T, 9).max()) for i, p in enumerate(places) if i]
        return pd.DataFrame({"pick": np.arange(1, len(places) + 1), "key": frame["key"].to_numpy()[places], "similarity": pd.array(near, "Float64")})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(answer, "pick long, key long, similarity double")


def _sums_of_all(rows: DataFrame) -> np.ndarray:
    """The exact sum of all vectors, combined on the map side."""
    some = rows.select(F.size("unit").alias("n")).first()
    if some is None:
        return np.zeros(0)
    found = rows.agg(*[F.sum(F.col("unit")[d]).alias(f"s{d}") for d in range(some["n"])]).first()
    return np.array(found, float)
