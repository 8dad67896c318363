"""Streams of log rows: append and compact, spend windows with a guard, promotion of settled values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.relational import latest_wins


def appended(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column]) -> DataStreamWriter:
    """Append each batch, its last row a key only, below ``path`` under its number.

    A batch that is run again after a failure writes over itself, so no row comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def compacted(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key over all batches."""
    return latest_wins(spark.read.parquet(path), keys, [*order, F.desc("batch")]).drop("batch")


def pending(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def spend(events: DataFrame, per: str, every: str, late: str, limit: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """(start, end, spend, over): sums of windows ``per`` long, one ``every`` so often, against a limit.

    Events later than ``late`` after the newest are dropped, as the watermark has it.
    """
    window = F.window(ts, per, every)
    sums = events.withWatermark(ts, late).groupBy(window).agg(F.sum(value).alias("spend"))
    return sums.select("window.start", "window.end", "spend", (F.col("spend") > limit).alias("over"))


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events of a key with no pause longer than ``gap``; an extension."""
    runs = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, "session_window.start", "session_window.end", "n")


def settled(observations: DataFrame, least: int, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value), once for each key whose first ``least`` observations, and all up to then, agree.

    observations: key string, value string.  The state of a key is its value, its count, and whether
    it is over: a key that disagreed or was promoted stays as it is for good.
    """

    def watch(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, count, over = state.get if state.exists else (None, 0, False)
        for batch in batches:
            seen = batch["value"].dropna()
            if over or seen.empty:
                continue
            held = seen.iloc[0] if held is None else held
            count, over = count + len(seen), bool((seen != held).any())
        if not over and count >= least:
            over = True
            yield pd.DataFrame({"key": [keys[0]], "value": [held]})
        state.update((held, count, over))

    rows = observations.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(
        watch, "key string, value string", "held string, count long, over boolean", "append", GroupStateTimeout.NoTimeout
    )
