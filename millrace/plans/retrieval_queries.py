"""Retrieval: the passages of ``benchmark`` are the queries, ``documents`` the catalog; an embedding belongs to
the passage and to the document of the same id."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import STOP_WORDS
from millrace.operators import retrieval, vectors
from millrace.operators.lineage import checkpointed
from millrace.plans.tables import table

#: What separates words, as a class of characters that every engine reads alike.
BETWEEN = r"[ \t\n\r.,;:!?()\"']+"


def _entries(rows, key, name):
    """(name, tokens): the distinct words of every text."""
    words = F.array_distinct(F.split(F.lower("text"), BETWEEN))
    return rows.select(F.col(key).alias(name), F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)).alias("tokens"))


def _catalog(spark, sf_dir):
    """(query_id, token) of the passages, (id, tokens) of the documents."""
    asked = _entries(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "query_id")
    queries = checkpointed(asked.select("query_id", F.explode("tokens").alias("token")).distinct())
    return queries, _entries(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "id")


def _vectors(spark, sf_dir):
    """Vectors of the passages (query_id, vector) and of the documents (id, vector)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")).where("vector is not null")
    of = lambda name, key, to: e.withColumnRenamed("vec_id", to).join(table(spark, sf_dir, name).select(F.col(key).alias(to)), to, "left_semi")
    return of("benchmark", "item_id", "query_id"), of("documents", "doc_id", "id")


def _shown(column):
    """Six places as SQL rounds them: the product is rounded as a binary number.  ``F.round`` rounds the number as
    printed, and the two part where eight places end in 50."""
    return F.round(F.col(column) * 1e6) / 1e6


def t3_index_search(spark, sf_dir):
    """The twelve best documents of every passage by F-beta, and all at 0.45 or more."""
    queries, entries = _catalog(spark, sf_dir)
    found = retrieval.scan(queries, entries, retrieval.LEXICAL_TOP, floor=retrieval.LEXICAL_FLOOR)
    return found.select("query_id", "id", "overlap", _shown("score").alias("score"), "rank")


def v6_union_retrieval(spark, sf_dir):
    queries, entries = _catalog(spark, sf_dir)
    return retrieval.union_retrieval(queries, entries, vectors.within(*_vectors(spark, sf_dir), k=retrieval.SEMANTIC_CAP))


def v7_staged_match(spark, sf_dir):
    queries, entries = _catalog(spark, sf_dir)
    return retrieval.staged_match(queries, entries, *_vectors(spark, sf_dir))


_WORDS = f"""(SELECT *, unnest(list_distinct(regexp_split_to_array(lower(text), '{BETWEEN.replace("'", "''")}'))) AS token FROM {{table}})
WHERE length(token) > 1 AND token NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})"""
_PAIRS = f"""q AS (SELECT DISTINCT item_id AS query_id, token FROM {_WORDS.format(table="benchmark")}),
d AS (SELECT DISTINCT doc_id AS id, token FROM {_WORDS.format(table="documents")}),
nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
nd AS (SELECT id, count(*) AS size, sha256(string_agg(token, ' ' ORDER BY token)) AS same FROM d GROUP BY 1),
met AS (SELECT query_id, id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2),
lex AS (SELECT query_id, id, overlap, n, size, same, round(1.25 * overlap / (0.25 * n + size), 8)::DOUBLE AS score FROM met JOIN nq USING (query_id) JOIN nd USING (id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 12 OR score >= 0.45),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
sem AS (SELECT item_id AS query_id, doc_id AS id, round(least(greatest(round(list_dot_product(a.v, b.v) / (a.m * b.m), 8), 0.0), 1.0), 6)::DOUBLE AS similarity,
  row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(a.v, b.v) / (a.m * b.m), 8) DESC, doc_id) AS nth
  FROM benchmark JOIN e a ON a.vec_id = item_id, documents JOIN e b ON b.vec_id = doc_id)"""
SQL = {
    "t3_index_search": f"WITH {_PAIRS} SELECT query_id, id, overlap::INT AS overlap, round(score, 6) AS score, rank::INT AS rank FROM top",
    "v6_union_retrieval": f"""WITH {_PAIRS}, near AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM sem WHERE nth <= 50),
both_ AS (SELECT query_id, id FROM top UNION SELECT query_id, id FROM near WHERE (place <= 15 OR similarity >= 0.55) AND query_id IN (SELECT query_id FROM nq)),
rows_ AS (SELECT query_id, id, same, round(coalesce(exact, 0), 6)::DOUBLE AS lexical, coalesce(similarity, 0)::DOUBLE AS semantic,
  round(0.55 * coalesce(similarity, 0) + 0.45 * round(coalesce(exact, 0), 6), 6)::DOUBLE AS retrieval
  FROM both_ LEFT JOIN (SELECT query_id, id, 1.25 * overlap / (0.25 * n + size) AS exact FROM lex) USING (query_id, id) LEFT JOIN near USING (query_id, id) LEFT JOIN (SELECT id, same FROM nd) USING (id)),
kept AS (SELECT * FROM rows_ QUALIFY same IS NULL OR row_number() OVER (PARTITION BY query_id, same ORDER BY retrieval DESC, id) = 1)
SELECT query_id, id, lexical, semantic, retrieval, row_number() OVER (PARTITION BY query_id ORDER BY retrieval DESC, id)::INT AS rank,
  row_number() OVER (PARTITION BY query_id ORDER BY retrieval DESC, id) <= 15 AS in_prompt FROM kept""",
    "v7_staged_match": f"""WITH {_PAIRS}, one AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) <= 40),
two AS (SELECT query_id, id, round(0.8 * (1.25 * overlap / (0.25 * n + size)) + 0.2 * coalesce(least(greatest(c, 0.0), 1.0), 0), 4)::DOUBLE AS score, count(*) OVER (PARTITION BY query_id) AS n_candidates
  FROM one LEFT JOIN (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v) / (a.m * b.m), 8) AS c FROM e a, e b) USING (query_id, id)),
led AS (SELECT *, row_number() OVER w AS nth, round(score - coalesce(lead(score) OVER w, 0), 4)::DOUBLE AS margin FROM two WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id))
SELECT query_id, id, score, margin, CASE WHEN score >= 0.75 AND margin >= 0.08 THEN 'high' WHEN score >= 0.55 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'unresolved' END AS quality, n_candidates FROM led WHERE nth = 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
