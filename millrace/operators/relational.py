"""Relational operators as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total for a repeatable result."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def having_all(facts: DataFrame, key: str, item: str, required: Sequence) -> DataFrame:
    """Relational division: keys that have every required item."""
    return (
        facts.where(F.col(item).isin(list(required)))
        .groupBy(key)
        .agg(F.count_distinct(item).alias("n"))
        .where(F.col("n") == len(set(required)))
        .select(key)
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same key; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def latest_wins(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Compaction of an append log: the last row of each key."""
    return first_per_key(log, keys, order)


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: modal value (smallest on ties), its share, rows and distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("modal"),
        (F.max("n") / F.sum("n")).alias("modal_share"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def with_margin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], score: str) -> DataFrame:
    """Rank and the lead over the next row; the last row's lead is its own score."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(window), F.lit(0.0)))


def category_shares(df: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str]) -> DataFrame:
    """Rows per key, and per category their count and share."""
    count = lambda c: F.count_if(F.col(category) == c)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[count(c).alias(f"n_{c}") for c in categories],
        *[(count(c) / F.count(F.lit(1))).alias(f"share_{c}") for c in categories],
    )


def distribution(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """Mean, sample deviation (0 for one row) and exact interpolated quantiles per key."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        *[F.percentile(value, q).alias(f"p{round(100 * q):02d}") for q in quantiles],
    )


def pareto_front(df: DataFrame, group: str, key: str, smaller: Sequence[str]) -> DataFrame:
    """Rows that no other row of the group beats in one value without losing in another; meant for
    groups that a cap upstream keeps small."""
    a, b = df.alias("a"), df.alias("b")
    at_least = F.lit(True)
    better = F.lit(False)
    for c in smaller:
        at_least &= F.col(f"b.{c}") <= F.col(f"a.{c}")
        better |= F.col(f"b.{c}") < F.col(f"a.{c}")
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") != F.col(f"b.{key}")) & at_least & better, "left_anti")
