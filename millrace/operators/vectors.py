"""Nearest neighbours and centroids of vectors kept as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block; a task holds two blocks and their products.
BLOCK_ROWS = 2048
#: For neighbours among all vectors: blocks that more vectors are dealt to before blocks grow, the most vectors of a
#: block, and the rows of a block that are multiplied at once.
PAIR_BLOCKS, PAIR_ROWS, STRIPE_ROWS = 16, 32_768, 256


def neighbours(vectors: DataFrame, k: int, least: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, match, similarity): per vector the k nearest others with a cosine of at least ``least``.

    Vectors are dealt to blocks by a hash of their key, and each unordered pair of blocks is one task, which asks
    in both directions and multiplies stripe by stripe.  A vector travels once for each block, and blocks grow to
    ``PAIR_ROWS`` before their number does, so up to some 500,000 vectors what is sent grows with the vectors;
    the products grow with their square, as the job is exact.  A cell passes on k rows a vector at most.
    Similarities are rounded to six places; of equal ones the lesser key goes first.
    """
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kept = kind if kind in ("float", "double") else "double"  # cast in the task, as floats are half as wide
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{kept}>").alias("vector"))
    n = rows.count()
    blocks = max(1, min(PAIR_BLOCKS, -(-n // BLOCK_ROWS)), -(-n // PAIR_ROWS))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.withColumn("a", mine).withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(blocks - 1))))
    right = rows.withColumn("b", mine).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b"))))

    def nearest(names: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(x), STRIPE_ROWS):
            mine = names[at : at + STRIPE_ROWS]
            products = x[at : at + STRIPE_ROWS] @ y.T
            row, to = np.nonzero(products >= least - 1e-6)
            found = np.round(products[row, to], 6)
            good = (found >= least) & (mine[row] != others[to])
            row, to, found = row[good], to[good], found[good]
            order = np.lexsort((others[to], -found, row))
            row, to, found = row[order], to[order], found[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            best = nth < k
            yield pd.DataFrame({"id": mine[row[best]], "match": others[to[best]], "similarity": found[best]})

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.array([], np.int64), "match": np.array([], np.int64), "similarity": np.array([], float)})]
        if not x.empty and not y.empty:
            sides = []
            for side in (x, y):
                values = np.stack(side["vector"]).astype(float)
                sides += [side["id"].to_numpy(), values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)]
            out += nearest(*sides)
            if x["a"].iloc[0] != x["b"].iloc[0]:
                out += nearest(*sides[2:], *sides[:2])
        return pd.concat(out)

    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "id long, match long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "match")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias(key), "match", "similarity")


def within(queries: DataFrame, rows: DataFrame, least: float = -1.0, query: tuple[str, str] = ("query_id", "vector"), row: tuple[str, str] = ("id", "vector"), k: int | None = None) -> DataFrame:
    """(query key, row key, similarity): all pairs of a query and a row with a cosine of ``least`` or more;
    with ``k`` the k nearest of them for each query, of equal ones those of lesser key.

    ``query`` and ``row`` name the key (a whole number) and the vector of each side.  Exact: each block of
    queries meets each block of rows in one product of matrices; vectors of zeros are at 0 from all.  Rows
    are sent once for each block of queries, so this is for stated query sets.  Similarities are rounded to
    eight places.
    """
    named = lambda df, names: df.select(F.col(names[0]).cast("long").alias("id"), F.transform(names[1], lambda x: x.cast("double")).alias("vector")).where("vector is not null")
    sides = named(queries, query), named(rows, row)
    blocks = [max(1, -(-side.count() // BLOCK_ROWS)) for side in sides]
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].select("*", block(blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    right = sides[1].select("*", block(blocks[1]).alias("b"), every(blocks[0]).alias("a"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"q": [], "r": [], "similarity": []})
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        products = np.round(unit(np.stack(x["vector"])) @ unit(np.stack(y["vector"])).T, 8)
        good = products >= least
        if k is not None and k < products.shape[1]:
            order = np.lexsort((np.broadcast_to(y["id"].to_numpy(), products.shape), -products), axis=1)[:, :k]
            near = np.zeros_like(good)
            np.put_along_axis(near, order, True, axis=1)
            good &= near
        at, to = np.nonzero(good)
        return pd.DataFrame({"q": x["id"].to_numpy()[at], "r": y["id"].to_numpy()[to], "similarity": products[at, to]})

    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "q long, r long, similarity double")
    if k is not None:
        nearest_first = Window.partitionBy("q").orderBy(F.desc("similarity"), "r")
        cells = cells.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return cells.select(F.col("q").alias(query[0]), F.col("r").alias(row[0]), "similarity")


def cosine(a: str, b: str) -> Column:
    """The cosine of two columns of vectors, rounded to eight places; vectors of zeros are at 0 from all."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.round(dot(a, b) / norms, 8))


def centroids(vectors: DataFrame, group: str, vector: str, dimensions: int) -> DataFrame:
    """(group, centroid): the mean of each group's vectors at length one, combined on the map side."""
    means = vectors.groupBy(group).agg(F.array(*[F.avg(F.col(vector)[k].cast("double")) for k in range(dimensions)]).alias("mean"))
    return means.select(group, unit("mean").alias("centroid"))


def unit(vector: str) -> Column:
    """A vector at length one; of zeros, itself."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))
