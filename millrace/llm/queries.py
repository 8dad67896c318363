"""The training-data queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, fingerprints, gru_lm, near_dup, packing, periodic_runs, pieces, pii, suffix_dedup, toxicity, url_trust, vector_codes

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the url filter (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2, capacity=1024)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_BPE)
    encoded = pieces.encode_sampled(_table(spark, sf_dir, "documents"), model, seed=17, temperature=0.3)
    return pieces.decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids_crc32",
        "log_probability",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(_table(spark, sf_dir, "documents"), threshold_percent=85)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d"""

OP9_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS said
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker NOT IN ('system', 'unknown')),
turned AS (
  SELECT s.conv_id, perspective, turn, speaker, said,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM turned),
rendered AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, segment
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rendered)
SELECT conv_id, perspective, turn, role, name, segment, start,
       start + length(head) AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(segment) - 1 ELSE start + length(head) END AS mask_end,
       start + length(segment) AS "end"
FROM placed"""



def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after the other: codebooks b0 to b4, assignments a0 to a4."""
    nearest = lambda k: f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min_by(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT vec_id, x.part, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN b{k} b USING (part, place) GROUP BY ALL)
  GROUP BY ALL)"""  # noqa: E731
    moved = lambda k: f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT x.part, a.entry, x.place, floor(sum(x.v) / count(*))::BIGINT AS v FROM x JOIN a{k} a USING (vec_id, part) GROUP BY ALL) m
  USING (part, entry, place))"""  # noqa: E731
    steps = ",\n".join(f"{nearest(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, i // width AS part, i % width AS place, floor(1024 * v[i + 1])::BIGINT AS v FROM kept, unnest(range(0, len(v))) u(i)),
b0 AS MATERIALIZED (
  SELECT part, entry, place, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {entries}),
{steps},
{nearest(rounds)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM coded"""


#: Texts as hex digits, two a byte; windows are cut from pieces of 149 bytes that overlap.
OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, n, k * 100 AS base, substr(h, k * 200 + 1, 298) AS piece FROM d, unnest(range(0, (n + 99) // 100)) u(k)),
w AS MATERIALIZED (SELECT doc_id, base + j AS s, substr(piece, 2 * j + 1, 100) AS g FROM pieces, unnest(range(0, 100)) u(j) WHERE base + j + 50 <= n),
f AS (SELECT g, min(doc_id) AS head FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true)::INT AS fresh FROM w JOIN f USING (g) WHERE doc_id > head),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r) GROUP BY doc_id, span),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_sentencepiece,
        op4_url_filters,
        op5_near_dedup,
        op6_fingerprints,
        op7_exact_dedup,
        op8_language_model,
        op9_chat_formatting,
        op10_personal_data,
        op11_vector_codes,
        op12_periodic_runs,
        op13_suffix_dedup,
    )
}
ORACLE_SQL = {"op7_exact_dedup": OP7_SQL, "op9_chat_formatting": OP9_SQL, "op11_vector_codes": _op11_sql(), "op13_suffix_dedup": OP13_SQL}
