"""Fuzzy ratios over foods and terms, and the dedup plan over vectors, words and names of the same ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fuzzy, scores, text
from millrace.operators import dedup_plan
from millrace.operators.lineage import stored
from millrace.plans import scalar_queries, vector_queries
from millrace.plans.scalar_queries import TERMS
from millrace.plans.tables import foods, table

#: Bounds for the given vectors, which lie further apart than the fixed ones ask.
LEAST = (0.3, 0.3, 0.3)


def _term_scores(spark, sf_dir, name, score, tokens=False):
    """(food_id, term, name): every food's name against a stated list of terms.  A name is scored once, whatever foods
    bear it; ``score`` reads the columns term and description and, with ``tokens``, t and d."""
    made = lambda x: text.tokens(x) if tokens else F.array().cast("array<string>")
    food = foods(spark, sf_dir).select("food_id", "description")
    # tokens are made in a step of their own: expressions put together would make them again wherever they are read
    names = stored(food.select("description").distinct().select("description", made(F.col("description")).alias("d")), "names")
    terms = F.inline(F.array(*[F.struct(F.lit(x).alias("term"), made(F.lit(x)).alias("t")) for x in TERMS]))
    scored = names.select("description", "d", terms).select("description", "term", F.round(score, 6).alias(name))
    scores_ = stored(scored.groupBy("description").agg(F.collect_list(F.struct("term", name)).alias("scores")), "scores")
    met = food.alias("f").join(scores_.alias("s"), F.expr("f.description <=> s.description"))
    return met.select("food_id", F.inline("scores"))


def st19_token_set_ratio(spark, sf_dir):
    return _term_scores(spark, sf_dir, "ratio", fuzzy.token_set_ratio("term", "description"))


def st20_lexical_overlap(spark, sf_dir):
    return _term_scores(spark, sf_dir, "score", fuzzy.lexical_overlap(F.col("t"), F.col("d"), F.col("description")), tokens=True)


def st22_label_scores(spark, sf_dir):
    return _term_scores(spark, sf_dir, "score", fuzzy.label_score(F.col("term"), F.col("description")))


def v3_token_set_pairs(spark, sf_dir):
    """Neighbours scored by vectors, words and the token-set ratio of the names of the foods of the same ids."""
    meta = foods(spark, sf_dir).select("food_id", "description", F.split("description", " ").alias("w"))
    side = lambda end, key: meta.select(F.col("food_id").alias(key), F.col("description").alias(f"title_{end}"), F.col("w").alias(f"w_{end}"))
    pairs = vector_queries.v2_neighbour_pairs(spark, sf_dir).join(side("a", "vec_id"), "vec_id").join(side("b", "match"), "match")
    parts = (F.col("similarity"), scores.jaccard(F.col("w_a"), F.col("w_b")), fuzzy.token_set_ratio("title_a", "title_b") / 100)
    hybrid = sum((w * x for w, x in zip(dedup_plan.WEIGHTS, parts)), F.lit(0.0))
    return pairs.select("vec_id", "match", F.round(hybrid, 8).alias("hybrid"))


def _rows(spark, sf_dir):
    words = F.split("description", " ")
    food = foods(spark, sf_dir).select(
        F.col("food_id").alias("id"), words.alias("items"), F.col("description").alias("title"), F.col("size").alias("n_items"), F.length("data_type").alias("n_directions")
    )
    return food.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")


def p3_valid_pairs(spark, sf_dir):
    pairs = dedup_plan.unordered(vector_queries.v2_neighbour_pairs(spark, sf_dir), "vec_id")
    parts = [F.round(c, 6).alias(c) for c in ("similarity", "jaccard", "title")]
    return dedup_plan.valid_pairs(pairs, _rows(spark, sf_dir), LEAST).select("a", "b", *parts, "hybrid")


def p3_dedup_plan(spark, sf_dir):
    """For every food with a vector its group, the group's keeper and whether it is that."""
    return dedup_plan.plan(_rows(spark, sf_dir), p3_valid_pairs(spark, sf_dir))


def _ratio_sql(rows: str) -> str:
    """CTEs that end in ``ratios``: ``rows`` (with texts a and b) and the token-set ratio of these."""
    words = "list_sort(list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')))"
    return f"""r1 AS (SELECT *, {words.format("a")} AS ta, {words.format("b")} AS tb FROM {rows}),
r2 AS (SELECT *, array_to_string(list_filter(ta, lambda w: NOT list_contains(tb, w)), ' ') AS da, array_to_string(list_filter(tb, lambda w: NOT list_contains(ta, w)), ' ') AS db,
  length(array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ')) AS n FROM r1),
r3 AS (SELECT *, length(da) AS x, length(db) AS y, (1::BIGINT << length(da)) - 1 AS full_ FROM r2),
r4 AS (SELECT *, CASE WHEN x = 0 OR y = 0 THEN 0 ELSE x - bit_count(list_reduce(
  list_prepend(full_, list_transform(string_split(db, ''), lambda c: coalesce(list_sum(list_transform(range(x), lambda i: CASE WHEN da[i + 1] = c THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT)),
  lambda s, m: ((s + (s & m)) | (s - (s & m))) & full_)) END AS lcs, n + (n > 0)::INT + x AS wx, n + (n > 0)::INT + y AS wy FROM r3),
ratios AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE WHEN n > 0 AND (x = 0 OR y = 0) THEN 100.0
  ELSE 100 * greatest(1 - (x + y - 2 * lcs) / (wx + wy), CASE WHEN n > 0 THEN greatest(1 - (1 + x) / (n + wx), 1 - (1 + y) / (n + wy)) ELSE 0 END) END AS ratio FROM r4)"""


_TERM_ROWS = f"t AS (SELECT p_partkey AS food_id, p_name AS d, unnest({scalar_queries._list(TERMS)}) AS term FROM part)"
_NAMES = ", f AS (SELECT p_partkey AS id, p_name AS t, string_split(p_name, ' ') AS w, p_size AS n_items, length(p_type) AS n_directions FROM part)"
_JACCARD = "len(list_intersect(f1.w, f2.w)) / len(list_distinct(f1.w || f2.w))"
_VALID = f"""{vector_queries._NEAR.replace("WITH", "WITH RECURSIVE", 1)}{_NAMES},
once AS (SELECT least(vec_id, match) AS ea, greatest(vec_id, match) AS eb, max(similarity) AS similarity FROM near GROUP BY 1, 2),
titled AS (SELECT ea, eb, similarity, {_JACCARD} AS jaccard, f1.t AS a, f2.t AS b FROM once JOIN f f1 ON f1.id = ea JOIN f f2 ON f2.id = eb),
{_ratio_sql("titled")},
valid AS (SELECT ea AS a, eb AS b, round(similarity, 6) AS similarity, round(jaccard, 6) AS jaccard, round(ratio / 100, 6) AS title, round(0.5 * similarity + 0.35 * jaccard + 0.15 * (ratio / 100), 8)::DOUBLE AS hybrid
  FROM ratios WHERE similarity >= {LEAST[0]} AND jaccard >= {LEAST[1]} AND round(0.5 * similarity + 0.35 * jaccard + 0.15 * ratio / 100, 8) >= {LEAST[2]})"""
SQL = {
    "st19_token_set_ratio": f"WITH {_TERM_ROWS}, p AS (SELECT food_id, term, term AS a, d AS b FROM t), {_ratio_sql('p')} SELECT food_id, term, round(ratio, 6) AS ratio FROM ratios",
    "st20_lexical_overlap": f"""WITH {_TERM_ROWS}, k AS (SELECT *, {scalar_queries._tokens("term")} AS qa, {scalar_queries._tokens("d")} AS qb FROM t),
p AS (SELECT food_id, term, qa, qb, array_to_string(list_sort(qa), ' ') AS a, d AS b FROM k), {_ratio_sql("p")},
s AS (SELECT *, len(list_intersect(qa, qb)) AS m FROM ratios)
SELECT food_id, term, round(CASE WHEN len(qa) = 0 THEN 0.0 ELSE 0.7 * CASE WHEN m = 0 THEN 0.0 ELSE 1.25 * (m / len(qb)) * (m / len(qa)) / (0.25 * (m / len(qb)) + m / len(qa)) END + 0.3 * ratio / 100 END, 6)::DOUBLE AS score FROM s""",
    "v3_token_set_pairs": f"""{vector_queries._NEAR}{_NAMES}, titled AS (SELECT vec_id, match, similarity, {_JACCARD} AS jaccard, f1.t AS a, f2.t AS b FROM near JOIN f f1 ON f1.id = vec_id JOIN f f2 ON f2.id = match), {_ratio_sql("titled")}
SELECT vec_id, match, round(0.5 * similarity + 0.35 * jaccard + 0.15 * ratio / 100, 8)::DOUBLE AS hybrid FROM ratios""",
    "p3_valid_pairs": f"{_VALID} SELECT * FROM valid",
    "p3_dedup_plan": f"""{_VALID}, ends AS (SELECT a AS x, b AS y FROM valid UNION ALL SELECT b, a FROM valid),
rows_ AS (SELECT f.* FROM f SEMI JOIN embeddings ON vec_id = f.id),
reach(id, c) AS (SELECT id, id FROM rows_ UNION SELECT y, c FROM reach JOIN ends ON x = reach.id),
named AS (SELECT id, min(c) AS component FROM reach GROUP BY 1)
SELECT id, component, first_value(id) OVER w AS keeper, first_value(id) OVER w = id AS kept FROM named JOIN rows_ USING (id) WINDOW w AS (PARTITION BY component ORDER BY n_items DESC, n_directions DESC, id)""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "st22_label_scores")}
