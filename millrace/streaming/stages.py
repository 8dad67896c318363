"""Stage events of runs: put in order by sequence number, with gaps named, and progress figures.

``ordered`` is the stream operator, ``ordered_batch`` gives what it ends in once all events are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run string, seq long, kind string, stage string, payload string"


def ordered(events: DataFrame, wait_seconds: int, late: str) -> DataFrame:
    """(run, seq, kind, stage, payload) of the events of each run by ``seq``, which counts from 0.

    ``events`` has run, seq, stage, payload (strings) and ts (a timestamp).  An event that comes early is held in
    the state of its run.  Once the watermark (``late`` behind the newest event) is ``wait_seconds`` beyond the
    oldest event held, the numbers missing before it are given up: one row of kind ``gap`` bears the first of
    them, its payload the last, and the events held go on.  One that comes after its gap is passed on as kind
    ``late``; a number that was passed on before is dropped, and of equal numbers the first to come stays.
    Null runs or numbers are dropped.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, text, gone = state.get if state.exists else (0, "[]", "[]")
        held = {int(x[0]): x for x in json.loads(text)}
        missing = [tuple(x) for x in json.loads(gone)]  # ranges given up
        out: list[tuple] = []

        def drain() -> None:
            nonlocal due
            while due in held:
                _, stage, payload, _ = held.pop(due)
                out.append((keys[0], due, "event", stage, payload))
                due += 1

        if state.hasTimedOut:
            first = min(held)
            out.append((keys[0], due, "gap", None, str(first - 1)))
            missing.append((due, first - 1))
            due = first
            drain()
        else:
            for batch in batches:
                for seq, stage, payload, ms in zip(batch["seq"].tolist(), batch["stage"], batch["payload"], batch["ms"].tolist()):
                    if seq >= due:
                        held.setdefault(int(seq), [int(seq), stage, payload, int(ms)])
                        continue
                    for place, (a, b) in enumerate(missing):
                        if a <= seq <= b:  # the range falls apart around the late number
                            missing[place : place + 1] = [r for r in ((a, seq - 1), (seq + 1, b)) if r[0] <= r[1]]
                            out.append((keys[0], seq, "late", stage, payload))
                            break
            drain()
        state.update((due, json.dumps(list(held.values())), json.dumps(missing)))
        if held:
            at = min(x[3] for x in held.values()) + 1000 * wait_seconds
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["run", "seq", "kind", "stage", "payload"])

    rows = events.where("run is not null and seq is not null").withWatermark("ts", late)
    rows = rows.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), "stage", "payload", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("run").applyInPandasWithState(step, SCHEMA, "due long, held string, missing string", "append", GroupStateTimeout.EventTimeTimeout)


def ordered_batch(events: DataFrame) -> DataFrame:
    """(run, seq, kind, stage, payload): the first event of each number and the gaps between numbers; ``events``
    has run, seq, stage, payload and ts."""
    kept = events.where("run is not null and seq is not null").groupBy("run", "seq").agg(F.min_by(F.struct("stage", "payload"), F.struct("ts", "stage", "payload")).alias("e"))
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("run").orderBy("seq")), F.lit(-1))
    placed = kept.withColumn("before", before)
    found = placed.select("run", "seq", F.lit("event").alias("kind"), "e.stage", "e.payload")
    gaps = placed.where("seq > before + 1").select("run", (F.col("before") + 1).alias("seq"), F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("stage"), (F.col("seq") - 1).cast("string").alias("payload"))
    return found.unionByName(gaps)


def progress(events: DataFrame, every: int, run: str = "run", ts: str = "ts", order: str = "seq") -> DataFrame:
    """(run, done, seconds, per_minute, eta_seconds) at every ``every``-th event of a run and at its last.

    The rate is of all events so far, null while no time has passed; the time left is what the rest of the run
    takes at that rate.
    """
    per = Window.partitionBy(run)
    so_far = events.select(run, ts, order).withColumn("done", F.row_number().over(per.orderBy(ts, order)))
    marked = so_far.withColumn("total", F.count(F.lit(1)).over(per)).withColumn("began", F.min(ts).over(per))
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("began").cast("timestamp"))
    shown = marked.withColumn("seconds", seconds).where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
    rate = F.when(F.col("seconds") > 0, F.col("done") * 60 / F.col("seconds"))
    return shown.select(run, "done", "seconds", F.round(rate, 6).alias("per_minute"), F.round((F.col("total") - F.col("done")) * F.col("seconds") / F.col("done"), 6).alias("eta_seconds"))


def observed(stream: DataFrame, name: str, value: str) -> DataFrame:
    """The stream with metrics of each batch under ``name``: rows, rows without ``value`` and their sum, which
    listeners and ``lastProgress`` show without a second pass."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), F.sum(value).alias("total"))
