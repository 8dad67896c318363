"""Plan of a hybrid dedup: pairs of near vectors, checked by items and titles, joined to groups with one keeper each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fuzzy, scores
from millrace.operators import hierarchy

# Weights of similarity, items and title; least similarity, Jaccard and blend of a valid pair.
WEIGHTS = (0.50, 0.35, 0.15)
LEAST = (0.92, 0.75, 0.88)


def unordered(neighbours: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, similarity) with a < b, once per pair, from (key, match, similarity)."""
    ends = F.least(key, "match").alias("a"), F.greatest(key, "match").alias("b")
    return neighbours.where(F.col(key) != F.col("match")).groupBy(*ends).agg(F.max("similarity").alias("similarity"))


def valid_pairs(pairs: DataFrame, rows: DataFrame, least: tuple[float, float, float] = LEAST) -> DataFrame:
    """(a, b, similarity, jaccard, title, hybrid) of the pairs that reach all three bounds.

    rows: (id, items array, title).  The title ratio is Python, so it is taken only of pairs that reach
    the first two bounds.  Pairs with an end that ``rows`` lacks, and rows with null ids, drop out.
    """
    side = lambda end: rows.select(F.col("id").alias(end), F.col("items").alias(f"items_{end}"), F.col("title").alias(f"title_{end}"))
    met = pairs.where(F.col("similarity") >= least[0]).join(side("a"), "a").join(side("b"), "b")
    none = F.array().cast("array<string>")
    met = met.withColumn("jaccard", scores.jaccard(F.coalesce("items_a", none), F.coalesce("items_b", none))).where(F.col("jaccard") >= least[1])
    scored = met.withColumn("title", fuzzy.token_set_ratio("title_a", "title_b") / 100)
    parts = (F.col("similarity"), F.col("jaccard"), F.col("title"))
    hybrid = F.round(sum((w * x for w, x in zip(WEIGHTS, parts)), F.lit(0.0)), 8)
    return scored.select("a", "b", *parts, hybrid.alias("hybrid")).where(F.col("hybrid") >= least[2])


def plan(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """(id, component, keeper, kept) for every row: linked rows form a group, named after its least id, and
    the row with most items, then the longest directions, then the least id stays.

    rows: (id, n_items, n_directions, ...); nulls count as 0.  Rows without a link are groups of their own
    and pass by without a shuffle of the groups; each group is folded to its keeper on the map side.
    """
    linked = hierarchy.components(valid.select("a", "b"))
    merit = F.struct(-F.coalesce("n_items", F.lit(0)), -F.coalesce("n_directions", F.lit(0)), F.col("id"))
    placed = rows.select("id", "n_items", "n_directions").join(linked.withColumnRenamed("node", "id"), "id", "left")
    keepers = placed.where("component is not null").groupBy("component").agg(F.min_by("id", merit).alias("keeper"))
    named = placed.join(keepers, "component", "left")
    return named.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("keeper", "id").alias("keeper"), F.coalesce(F.col("keeper") == F.col("id"), F.lit(True)).alias("kept"))
