"""Aggregated views kept up from changes of their base rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(base: DataFrame, keys: Sequence[str], sums: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """The view from scratch: per key ``n_rows``, sums as sum_..., least values as min_...; sums skip nulls
    and are 0 where all are null."""
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sums], *[F.min(c).alias(f"min_{c}") for c in least]
    )


def refresh(view: DataFrame, adds: DataFrame, deletes: DataFrame, base: DataFrame, keys: Sequence[str], sums: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """``view`` after the rows ``adds`` came and ``deletes`` (rows of the old base) went; ``base`` is the base
    after both.

    Counts and sums (whole numbers or decimals) come from the changes alone.  A least value is read again from
    ``base`` only for keys of which a row at the least value went.  Keys whose last row went leave the view.
    """
    change = lambda rows, sign: rows.select(*keys, F.lit(sign).alias("n_rows"), *[(sign * F.coalesce(F.col(c), F.lit(0))).alias(f"sum_{c}") for c in sums], *[(F.col(c) if sign > 0 else F.lit(None)).alias(f"min_{c}") for c in least])
    moved = view.select(*keys, "n_rows", *[f"sum_{c}" for c in sums], *[f"min_{c}" for c in least]).unionByName(change(adds, 1)).unionByName(change(deletes, -1))
    made = moved.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums], *[F.min(f"min_{c}").alias(f"min_{c}") for c in least]).where("n_rows > 0")
    if not least:
        return made
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    at_least = F.lit(False)
    for c in least:
        at_least |= F.col(f"d.{c}") <= F.col(f"v.min_{c}")
    stale = deletes.alias("d").join(view.alias("v"), [*same("d", "v"), at_least], "left_semi").select(*keys).distinct()
    fresh = base.alias("b").join(stale.alias("s"), same("b", "s"), "left_semi").groupBy(*keys).agg(*[F.min(c).alias(f"new_{c}") for c in least]).withColumn("read", F.lit(True))
    both = made.alias("m").join(fresh.alias("f"), same("m", "f"), "left")
    kept = [F.col(f"m.{c}").alias(c) for c in made.columns if not c.startswith("min_")]
    return both.select(*kept, *[F.when(F.col("f.read"), F.col(f"f.new_{c}")).otherwise(F.col(f"m.min_{c}")).alias(f"min_{c}") for c in least])


def refresh_report(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """Per value of ``kind`` the base rows before and after a refresh and what changed; null kinds count together."""
    n = lambda view, name: view.groupBy(kind).agg(F.sum("n_rows").alias(name))
    both = n(before, "n_before").unionByName(n(after, "n_after"), allowMissingColumns=True)
    summed = both.groupBy(kind).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_before", "n_after")])
    return summed.withColumn("change", F.col("n_after") - F.col("n_before"))
