"""Ontology closures and roll-ups over (child, parent) edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import checkpointed


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth) with every node at depth 0 and the least depth kept.

    Each round joins the frontier with the edges and cuts its lineage with a checkpoint in the folder
    that ``spark.checkpoint.dir`` names, so no round repeats the ones before.  It stops when nothing
    new appears, so cycles end too.  With ``max_depth``, deeper ancestors raise.
    """
    edges = checkpointed(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    reached = frontier = checkpointed(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    for depth in itertools.count(1):
        frontier = checkpointed(
            frontier.select("node", F.col("ancestor").alias("child"))
            .join(edges, "child")
            .select("node", F.col("parent").alias("ancestor"))
            .distinct()
            .join(reached.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            return reached
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"ancestors deeper than max_depth={max_depth}")
        reached = reached.unionByName(frontier)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), taken both ways.

    Every node takes the least label among its neighbours and that label's own label, so paths halve
    in each round; rounds go on until no label moves.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = checkpointed(met.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def rollup(lines: DataFrame, leaf: str, paths: DataFrame, active: DataFrame) -> DataFrame:
    """Add ``rolled``: the nearest active ancestor of each line's leaf, null without one."""
    nearest = (
        paths.join(active.select(F.col("node").alias("ancestor")), "ancestor")
        .groupBy("node")
        .agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("rolled"))
        .withColumnRenamed("node", "__leaf")
    )
    return lines.join(nearest, F.col(leaf) == F.col("__leaf"), "left").drop("__leaf")


def deepest_antichain(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes without a descendant in the same set."""
    inner = paths.where("depth > 0").join(nodes.select("node"), "node").select(F.col("ancestor").alias("above"))
    return nodes.join(inner, F.col("node") == F.col("above"), "left_anti")


def subtree_totals(lines: DataFrame, leaf: str, paths: DataFrame, recipe: str, grams: str) -> DataFrame:
    """Per node: lines, distinct recipes and grams of everything below it."""
    return (
        lines.join(paths, F.col(leaf) == F.col("node"))
        .groupBy("ancestor")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct(recipe).alias("n_recipes"), F.sum(grams).alias("grams"))
    )
