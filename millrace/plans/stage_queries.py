"""Stage logs: the turns of conversations in order with their gaps, progress of the users' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.tables import table
from millrace.streaming import stages


def ss6_ordered_stages(spark, sf_dir):
    """Turns by number, the first of equal ones; numbers that are missing as gaps."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("role").alias("stage"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload"), F.col("turn").alias("ts"))
    return stages.ordered_batch(turns.where("seq >= 0"))


def ss3_progress(spark, sf_dir):
    """Rate and time left of every user's events, at every tenth and the last."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("seq"))
    return stages.progress(events, 10)


SQL = {
    "ss6_ordered_stages": """WITH t AS (SELECT conv_id AS run, turn AS seq, role AS stage, sha256(coalesce(text, '')) AS payload FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, payload) = 1),
p AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY run ORDER BY seq), -1) AS before FROM t)
SELECT run, seq, 'event' AS kind, stage, payload FROM p UNION ALL SELECT run, before + 1, 'gap', NULL, (seq - 1)::VARCHAR FROM p WHERE seq > before + 1""",
    "ss3_progress": """WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS done, count(*) OVER (PARTITION BY user_id) AS total,
  (floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY user_id))))::BIGINT AS seconds FROM events)
SELECT run, done, seconds, CASE WHEN seconds > 0 THEN round(done * 60 / seconds, 6) END AS per_minute, round((total - done) * seconds / done, 6) AS eta_seconds FROM e WHERE done % 10 = 0 OR done = total""",
}
QUERIES = {name: globals()[name] for name in SQL}
