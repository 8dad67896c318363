"""Loads that go on where they were killed: key ranges, idempotent range folders and a commit log.

A load is planned once: the source's keys are cut into ranges of about ``page_rows`` rows, and the plan is
written.  Ranges are written in waves, one job a wave, so a load takes at most ``WAVES`` passes (or one for every
``LEAST_WAVE`` ranges) however many ranges there are.  Each range goes to a folder of its own, which is overwritten
if it exists, and then the log says that it is done.  A load that is killed between any two of these steps starts
again with the ranges that are not in the log, so nothing is lost and nothing comes twice; ``committed`` reads
only what the log names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of the plan that the driver holds at most.
MAX_RANGES = 10_000
#: Waves that a plan is written in, unless they would hold fewer than ``LEAST_WAVE`` ranges.
WAVES, LEAST_WAVE = 8, 64


def key_ranges(rows: DataFrame, key: str, page_rows: int) -> list[tuple[int, int]]:
    """(first key, last key) of consecutive ranges of about ``page_rows`` rows, cut at approximate quantiles of
    the keys, so gaps and outliers among them do no harm.  A single key is never cut; null keys are in no range.
    """
    ends = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not ends[2]:
        return []
    pages = min(MAX_RANGES, -(-ends[2] // page_rows))
    cuts = []
    if pages > 1:
        found = rows.agg(F.percentile_approx(key, [k / pages for k in range(1, pages)], 20 * pages)).first()[0]
        cuts = sorted({c for c in found if c < ends[1]})
    return list(zip([ends[0], *(c + 1 for c in cuts)], [*cuts, ends[1]]))


def _log(spark: SparkSession, target: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/{kind}")


_PLAN, _DONE = "place int, low long, high long", "place int, n_rows long, attempt int"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def done(spark: SparkSession, target: str) -> dict[int, int]:
    """Rows of the ranges that the log names."""
    if not _exists(spark, f"{target}/log"):
        return {}
    return {r["place"]: r["n_rows"] for r in _log(spark, target, "log", _DONE).collect()}


def _place(key: str, ranges: list[tuple[int, int, int]]) -> Column:
    """The range of ``ranges`` that a row's key is in, null where it is in none."""
    places, lows, highs = np.array(sorted(ranges, key=lambda r: r[1]), np.int64).T

    @F.pandas_udf("int")
    def found(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        values = keys[known].to_numpy(np.int64)
        at = np.searchsorted(lows, values, "right") - 1
        out = np.full(len(keys), None, object)
        out[known] = np.where((at >= 0) & (values <= highs[at]), places[at].astype(object), None)
        return pd.Series(out, dtype="Int32")

    return found(F.col(key).cast("long"))


def load(
    rows: DataFrame,
    key: str,
    target: str,
    page_rows: int = 50_000,
    *,
    attempts: int = 3,
    wait: float = 1.0,
    before_commit: Callable[[int], None] | None = None,
) -> int:
    """Write ``rows`` to ``target`` range by range and return the number of ranges written by this call.

    A call on a target that an earlier one left unfinished keeps that one's plan; rows whose keys lie beyond
    the planned ranges come as new ranges once those are done.  A wave that fails is tried ``attempts``
    times, with waits that double.  ``before_commit`` runs for each range between its write and its log entry;
    where it raises, the ranges of the wave before that one are logged.
    """
    spark = rows.sparkSession
    if _exists(spark, f"{target}/plan"):
        plan = [(r["place"], r["low"], r["high"]) for r in _log(spark, target, "plan", _PLAN).orderBy("place").collect()]
    else:
        plan = []
    written = 0
    while True:
        finished = done(spark, target)
        left = [r for r in plan if r[0] not in finished]
        wave = max(LEAST_WAVE, -(-len(left) // WAVES))
        _clear(spark, target, {r[0] for r in left})
        for at in range(0, len(left), wave):
            ranges = left[at : at + wave]
            mine = rows.where(F.col(key).between(min(r[1] for r in ranges), max(r[2] for r in ranges)))
            # a folder is written by one task, which holds whole ranges
            page = mine.withColumn("place", _place(key, ranges)).where("place is not null").repartition("place")
            _write(page, target, [r[0] for r in ranges], attempts, wait, before_commit)
            written += len(ranges)
        last = max((high for _, _, high in plan), default=None)
        rest = rows if last is None else rows.where(F.col(key) > last)
        fresh = [(len(plan) + k, *r) for k, r in enumerate(key_ranges(rest, key, page_rows))]
        if not fresh:
            return written
        spark.createDataFrame(fresh, _PLAN).coalesce(1).write.mode("append").parquet(f"{target}/plan")
        plan += fresh


def _clear(spark: SparkSession, target: str, places: set[int]) -> None:
    """Remove what a killed load left in the folders of ``places``, none of which is in the log."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/ranges")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(where) if places and files.exists(where) else ():
        name = found.getPath().getName()
        if name.startswith("place=") and int(name.removeprefix("place=")) in places:
            files.delete(found.getPath(), True)


def _write(page: DataFrame, target: str, places: list[int], attempts: int, wait: float, before_commit: Callable[[int], None] | None) -> None:
    """Write a wave and log its ranges; ``page`` has the rows and their place."""
    spark, folder = page.sparkSession, f"{target}/ranges"
    for attempt in range(1, attempts + 1):
        try:
            page.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place").parquet(folder)
            break
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(wait * 2 ** (attempt - 1))
    passed = []
    try:
        for place in places:
            if before_commit:
                before_commit(place)
            passed.append(place)
    finally:
        if passed:
            rows = spark.read.schema(page.schema).parquet(folder).where(F.col("place").isin(passed))
            n = {r["place"]: r["count"] for r in rows.groupBy("place").count().collect()}  # a row a range
            entries = [(place, n.get(place, 0), attempt) for place in passed]
            spark.createDataFrame(entries, _DONE).coalesce(1).write.mode("append").parquet(f"{target}/log")


def committed(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of all ranges that the log names, and no others."""
    folders = [f"{target}/ranges/place={place}" for place, n in sorted(done(spark, target).items()) if n]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
