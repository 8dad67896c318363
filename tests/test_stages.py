"""Streams of stage events with early, late, repeated and missing numbers."""

import json

from pyspark.sql import functions as F

from millrace.streaming import stages


def drain(spark, frame, path, checkpoint):
    query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_events_come_out_in_order_with_gaps(spark, tmp_path):
    """Run a: 2 comes early, 1 twice; then 4 waits for 3, which is given up and comes late.  Run b has no
    trouble.  Run z moves the watermark."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    steps = [
        [("a", 0, 0), ("a", 2, 1), ("b", 0, 1), (None, 5, 1), ("a", None, 1)],
        [("a", 1, 2), ("a", 1, 3), ("b", 1, 3), ("a", 4, 4)],
        [("z", 0, 300)],
        [("z", 1, 301)],
        [("a", 3, 300), ("a", 5, 301), ("a", 3, 302), ("a", 0, 303)],
        [("z", 2, 700)],
    ]
    for n, rows in enumerate(steps):
        (source / f"{n}.json").write_text("".join(json.dumps({"run": r, "seq": s, "stage": f"s{s}", "payload": f"{n}", "ts": at(t)}) + "\n" for r, s, t in rows))
        stream = spark.readStream.schema("run string, seq long, stage string, payload string, ts timestamp").json(str(source))
        drain(spark, stages.ordered(stream, 10, "5 seconds"), target, str(tmp_path / "cp"))
    rows = spark.read.parquet(target).collect()
    found = lambda run: sorted((r["seq"], r["kind"], r["payload"]) for r in rows if r["run"] == run)
    assert found("a") == [(0, "event", "0"), (1, "event", "1"), (2, "event", "0"), (3, "gap", "3"), (3, "late", "4"), (4, "event", "1"), (5, "event", "4")]
    assert found("b") == [(0, "event", "0"), (1, "event", "1")]
    assert found("z") == [(0, "event", "2"), (1, "event", "3"), (2, "event", "5")]


def test_batch_order_names_gaps(spark):
    rows = [("a", 3, "x", "p", 1), ("a", 0, "y", "q", 5), ("a", 0, "w", "r", 2), (None, 1, "x", "p", 1), ("b", 2, None, None, 1)]
    found = stages.ordered_batch(spark.createDataFrame(rows, "run string, seq long, stage string, payload string, ts long"))
    assert sorted((r["run"], r["seq"], r["kind"], r["stage"], r["payload"]) for r in found.collect()) == [
        ("a", 0, "event", "w", "r"), ("a", 1, "gap", None, "2"), ("a", 3, "event", "x", "p"), ("b", 0, "gap", None, "1"), ("b", 2, "event", None, None),
    ]


def test_progress_of_runs(spark):
    rows = [("a", k, f"2024-01-01 00:00:{k:02d}") for k in range(0, 24, 2)] + [("b", 0, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "run string, seq long, ts string").withColumn("ts", F.to_timestamp("ts"))
    found = {(r["run"], r["done"]): (r["seconds"], r["per_minute"], r["eta_seconds"]) for r in stages.progress(events, 5).collect()}
    assert found == {("a", 5): (8, 37.5, 11.2), ("a", 10): (18, 33.333333, 3.6), ("a", 12): (22, 32.727273, 0.0), ("b", 1): (0, None, 0.0)}


def test_batches_are_observed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"v": 2.5}\n{"v": null}\n{"v": 1.0}\n')
    stream = stages.observed(spark.readStream.schema("v double").json(str(source)), "load", "v")
    query = drain(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    metrics = [p["observedMetrics"]["load"] for p in query.recentProgress if p["numInputRows"]]
    assert [(m["rows"], m["missing"], m["total"]) for m in metrics] == [(3, 1, 3.5)]
