"""Two-stage match scores of stated queries against all foods; embeddings belong to the foods and queries of their ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import fuzzy, scores, staged, text
from millrace.plans import fuzzy_queries
from millrace.plans.scalar_queries import _list, _tokens
from millrace.plans.tables import foods, table

#: (query_id, name, preparation): a stated list of queries; the last has no vector.
MATCHES = ((0, "large gear", "chopped"), (7, "hot plates", ""), (77, "red bolt", "spicy, raw"), (300, "blue ring", "raw"), (-1, "small rod", "smoked"))
#: What foods' names are followed by, by their key.
STATES = ("", "raw", "chopped, raw", "spicy", "garlic, smoked", "fresh", "canned", "diced, cooked")


def _scored(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, STATES)), F.pmod("food_id", F.lit(len(STATES))).cast("int"))
    food = foods(spark, sf_dir).select("food_id", "description", F.concat_ws(" ", "description", state).alias("food_text"))
    food = food.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("food_id"), F.col("embedding").alias("food_vector")), "food_id", "left")
    food = food.select("*", text.tokens(F.col("description")).alias("food_tokens"), text.tokens(F.col("food_text")).alias("food_words"))
    asked = spark.createDataFrame(MATCHES, "query_id long, name string, preparation string").withColumn("query_text", F.concat_ws(" ", "name", "preparation"))
    asked = asked.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    asked = asked.select("*", text.tokens(F.col("name")).alias("name_tokens"), text.tokens(F.col("preparation"), drop_stop=False).alias("prep_tokens"), text.tokens(F.col("query_text")).alias("query_words"))
    # the queries are as many as MATCHES, so every food meets all of them in place
    pairs = food.crossJoin(F.broadcast(asked)).withColumn("near", F.round(scores.cosine(F.col("query_vector"), F.col("food_vector")), 6))
    pairs = pairs.withColumn("query", staged.modifiers(F.array_union("prep_tokens", "name_tokens"))).withColumn("food", staged.modifiers(F.col("food_words")))
    pairs = pairs.withColumn("by_name", fuzzy.lexical_overlap(F.col("name_tokens"), F.col("food_tokens"), F.col("description")))
    pairs = pairs.withColumn("by_text", fuzzy.OVERLAP_WEIGHT * scores.f_beta(F.col("query_words"), F.col("food_words")) + fuzzy.FUZZY_WEIGHT * fuzzy.token_set_ratio("query_text", "food_text") / 100)
    query, thing = F.col("query"), F.col("food")
    pairs = pairs.withColumn("base", F.round(staged.base_score(F.col("by_name"), F.col("near"), F.col("by_text"), F.col("near")), 8))
    pairs = pairs.withColumn("prep", F.round(staged.prep_score(F.col("prep_tokens"), F.when(F.col("query_id") % 2 == 1, F.col("near")), query, thing), 8))
    pairs = pairs.withColumn("bonus", staged.default_bonus(query, thing)).withColumn("penalty", F.round(staged.modifier_penalty(query, thing, F.col("food_tokens")), 8))
    final = F.round(staged.final_score(F.col("base"), F.col("prep"), F.col("bonus"), F.col("penalty")), 6)
    return pairs.select("query_id", "food_id", "base", "prep", "bonus", "penalty", final.alias("final"), staged.fallback(F.col("base"), F.col("prep"), F.col("prep_tokens"), thing).alias("reason"))


def m14_staged_scores(spark, sf_dir):
    """All stated queries against all foods."""
    return _scored(spark, sf_dir)


def m14_best_matches(spark, sf_dir):
    """Per query the best food, its lead over the next and the tier; the two best are found on the map side first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "food_id")
    led = _scored(spark, sf_dir).withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    best, second = F.max(F.when(F.col("nth") == 1, F.col("final"))), F.max(F.when(F.col("nth") == 2, F.col("final")))
    rows = led.groupBy("query_id").agg(F.min_by("food_id", "nth").alias("food_id"), F.min_by("reason", "nth").alias("reason"), best.alias("final"), F.round(best - F.coalesce(second, F.lit(0.0)), 6).alias("margin"))
    return rows.withColumn("tier", scores.match_tier(F.col("final"), F.col("margin"), 0.75, 0.55, 0.40, 0.08))


def _modifiers_sql(tokens: str, prefix: str) -> str:
    found = ", ".join(f"list_intersect({tokens}, {_list(words)}) AS {prefix}_{name}" for name, words in staged.MODIFIERS.items())
    every = f"list_intersect({tokens}, {_list(sorted({w for words in staged.MODIFIERS.values() for w in words}))}) AS {prefix}_all"
    return f"{found}, {every}"


_OVERLAP = "(CASE WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0::DOUBLE ELSE 1.25 * (len(list_intersect({a}, {b})) / len({b})) * (len(list_intersect({a}, {b})) / len({a})) / (0.25 * (len(list_intersect({a}, {b})) / len({b})) + len(list_intersect({a}, {b})) / len({a})) END)"
_ASKED = " + ".join(f"(len(q_{c}) > 0)::INT" for c in staged.RULED)
_MET = " + ".join(f"list_has_any(q_{c}, f_{c})::INT" for c in staged.RULED)
_STAGED = f"""WITH q0 AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', '{p}')" for k, n, p in MATCHES)}) v(query_id, name, preparation)),
q AS (SELECT *, name || ' ' || preparation AS qt, {_tokens("name")} AS nt, {_tokens("preparation").replace("NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ", ", "NOT IN (")} AS pt FROM q0),
f0 AS (SELECT p_partkey AS food_id, p_name AS d, p_name || ' ' || ({_list(STATES)})[p_partkey % {len(STATES)} + 1] AS ft FROM part),
f AS (SELECT *, {_tokens("d")} AS dt, {_tokens("ft")} AS fw FROM f0),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
k AS (SELECT *, {_tokens("qt")} AS qw FROM q, f),
m AS (SELECT k.*, {_modifiers_sql("list_distinct(pt || nt)", "q")}, {_modifiers_sql("fw", "f")}, round(list_dot_product(a.v, b.v) / (a.m * b.m), 6) AS near FROM k LEFT JOIN e a ON a.vec_id = query_id LEFT JOIN e b ON b.vec_id = food_id),
texts AS (SELECT query_id, food_id, 1 AS part_, array_to_string(list_sort(nt), ' ') AS a, d AS b FROM k UNION ALL SELECT query_id, food_id, 2, qt, ft FROM k),
{fuzzy_queries._ratio_sql("texts")},
wide AS (SELECT query_id, food_id, max(ratio) FILTER (part_ = 1) / 100 AS rn, max(ratio) FILTER (part_ = 2) / 100 AS rf FROM ratios GROUP BY 1, 2),
s AS (SELECT m.*, coalesce(least(greatest(near, 0.0), 1.0), 0) AS sim, 0.7 * {_OVERLAP.format(a="nt", b="dt")} + 0.3 * rn AS by_name, 0.7 * {_OVERLAP.format(a="qw", b="fw")} + 0.3 * rf AS by_text,
  CASE WHEN len(q_flavor_style) = 0 AND len(f_default_like) > 0 AND len(f_flavor_style) = 0 THEN 1.0 WHEN len(q_flavor_style) = 0 AND len(f_all) = 0 THEN 0.9 WHEN list_has_any(q_flavor_style, f_all) THEN 0.5 ELSE 0.2 END::DOUBLE AS bonus FROM m JOIN wide USING (query_id, food_id)),
b AS (SELECT *, round(0.3 * (0.8 * by_name + 0.2 * sim) + 0.7 * (0.8 * by_text + 0.2 * sim), 8)::DOUBLE AS base,
  round(0.4 * CASE WHEN abs(query_id) % 2 = 1 AND query_id > 0 AND near > 0 THEN least(near, 1.0) ELSE 0.5 END + 0.3 * CASE WHEN len(pt) = 0 THEN 0.5 ELSE len(list_intersect(pt, f_all)) / len(pt) END
    + 0.2 * CASE WHEN {_ASKED} = 0 THEN 0.5 ELSE ({_MET}) / ({_ASKED}) END + 0.1 * bonus, 8)::DOUBLE AS prep,
  round(CASE WHEN len(q_flavor_style) = 0 THEN 0.25 * len(f_flavor_style) ELSE 0 END + CASE WHEN len(q_all) > 0 THEN 0.08 * least(3, len([x FOR x IN f_all IF NOT list_contains(q_all, x) AND NOT list_contains(dt, x)])) ELSE 0 END, 8)::DOUBLE AS penalty FROM s),
scored AS (SELECT query_id::BIGINT AS query_id, food_id, base, prep, bonus, penalty, round(least(greatest(0.65 * base + 0.25 * prep + 0.1 * bonus - penalty, 0.0), 1.0), 6)::DOUBLE AS final,
  CASE WHEN base < 0.35 THEN 'weak_base' WHEN len(pt) > 0 AND prep >= 0.5 THEN 'exact_prep' WHEN len(pt) = 0 AND (len(f_default_like) > 0 OR len(f_all) = 0) THEN 'neutral_default' WHEN len(pt) > 0 AND prep < 0.35 THEN 'prep_fallback'
    WHEN len(f_flavor_style) > 0 AND len(pt) = 0 THEN 'unsupported_flavor_last_resort' ELSE 'base_only' END AS reason FROM b)"""
SQL = {
    "m14_staged_scores": f"{_STAGED} SELECT * FROM scored",
    "m14_best_matches": f"""{_STAGED}, led AS (SELECT *, round(final - coalesce(lead(final) OVER w, 0), 6)::DOUBLE AS margin, row_number() OVER w AS nth FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY final DESC, food_id))
SELECT query_id, food_id, reason, final, margin, CASE WHEN final >= 0.75 AND margin >= 0.08 THEN 'high' WHEN final >= 0.55 THEN 'medium' WHEN final >= 0.4 THEN 'low' ELSE 'unresolved' END AS tier FROM led WHERE nth = 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
