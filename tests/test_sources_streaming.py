"""Files in and out, and streams over small folders."""

import json

from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import logs


def test_csv_by_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Name\n1,"a ""b"", c"\n2,\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id long, title string", ["title", "id"])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [('a "b", c', 1), (None, 2)]


def test_nested_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_id": {"$oid": "x1"}, "ts": {"$date": 5}}) + "\n" + json.dumps({"_id": {"$oid": "x2"}}) + "\n")
    rows = files.read_documents(spark, str(tmp_path / "a.json"), "_id struct<`$oid`: string>, ts struct<`$date`: long>", {"id": "_id.$oid", "ms": "ts.$date"})
    assert sorted(tuple(r) for r in rows.collect()) == [("x1", 5), ("x2", None)]


def test_ids_reach_the_scan_and_pages_follow(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_report(spark.range(100), path)
    found = files.read_by_ids(spark, path, "id", [3, 5])
    assert sorted(r[0] for r in found.collect()) == [3, 5]
    assert "In(id, [3,5])" in found._jdf.queryExecution().executedPlan().toString()
    page = files.page_after(spark.read.parquet(path), "id", 41, 3)
    assert [r[0] for r in page.collect()] == [42, 43, 44]


def test_table_upkeep(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(files.refreshed(old, new, ["k"])) == [(1, "x"), (2, "c"), (3, "y"), (3, "y")]
    assert rows(files.inserted(old, new, ["k"])) == [(1, "a"), (1, "b"), (2, "c"), (3, "y")]
    assert rows(files.without_ids(old, new, "k")) == [(2, "c")]
    wider = files.with_columns(old, spark.createDataFrame([], "k int, z double").schema)
    assert wider.columns == ["k", "v", "z"] and wider.where("z is not null").isEmpty()
    tables = {"dish": spark.range(1), "line": spark.range(1).withColumn("dish_id", F.col("id"))}
    assert files.named_joins(tables) == [("line", "dish_id", "dish", "id")]
    assert ("line", "dish_id", "bigint") in files.described(tables)


def _drain(spark, query):
    started = query.start()
    started.processAllAvailable()
    started.stop()


def test_log_is_compacted_over_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    stream = lambda: spark.readStream.schema("k int, n int").json(str(source))
    for name, rows in (("a", [(1, 1), (2, 1), (1, 2)]), ("b", [(2, 5), (3, 1)])):
        (source / f"{name}.json").write_text("".join(json.dumps({"k": k, "n": n}) + "\n" for k, n in rows))
        _drain(spark, logs.appended(stream(), target, str(tmp_path / "cp"), ["k"], [F.desc("n")]))
    last = logs.compacted(spark, target, ["k"], [F.desc("n")])
    assert sorted(tuple(r) for r in last.collect()) == [(1, 2), (2, 5), (3, 1)]
    assert [r[0] for r in logs.pending(spark.createDataFrame([(1,), (4,)], "k int"), last, ["k"]).collect()] == [4]


def test_spend_windows_and_sessions(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:10", 5.0), (1, "2024-01-01 00:00:50", 7.0), (1, "2024-01-01 00:09:00", 1.0)], "user_id int, ts string, value double")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = logs.spend(events, "1 minute", "1 minute", "1 hour", 10.0)
    assert sorted((r["spend"], r["over"]) for r in minutes.collect()) == [(1.0, False), (12.0, True)]
    assert sorted(r["n"] for r in logs.sessions(events, "5 minutes", "1 hour").collect()) == [1, 2]


def test_values_settle_once(spark, tmp_path):
    """a settles with its third x and stays so; b and c disagree or are too few."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, rows in (("a", "ax ax by by bz"), ("b", "ax by cx"), ("c", "ay ax cx")):
        (source / f"{name}.json").write_text("".join(json.dumps({"key": r[0], "value": r[1]}) + "\n" for r in rows.split()))
        stream = spark.readStream.schema("key string, value string").json(str(source))
        _drain(spark, logs.settled(stream, 3).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")))
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [("a", "x")]
