"""Joins, aggregates, windows, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import relational as rel
from millrace.plans.tables import foods, recipe_lines, table


def p7_recipe_nutrients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nutrient amounts of each recipe's lines, one column per nutrient class; recipes without lines stay."""
    food = foods(spark, sf_dir).withColumn("nutrient", F.concat(F.lit("n"), F.pmod("size", F.lit(4)).cast("string")))
    wide = (
        recipe_lines(spark, sf_dir)
        .join(food, "food_id")
        .groupBy("recipe_id")
        .pivot("nutrient", ["n0", "n1", "n2", "n3"])
        .agg(F.sum(F.col("amount") * F.col("grams") / 100))
    )
    recipes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("kind"))
    return recipes.join(wide, "recipe_id", "left").select("recipe_id", "kind", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("n0", "n1", "n2", "n3")])


def pf1_foods_with_heavy_line(spark, sf_dir):
    lines = recipe_lines(spark, sf_dir).where("grams > 49")
    big = foods(spark, sf_dir).where("brand <> 'Brand#11'")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("recipe_id"))
    return big.join(lines, "food_id", "left_semi").join(recipe_lines(spark, sf_dir).join(orders, "recipe_id", "left_semi"), "food_id", "left_semi").select("food_id", "description")


def j3_compare_runs(spark, sf_dir):
    runs = recipe_lines(spark, sf_dir).where("status in ('A', 'R')")
    of = lambda s: runs.where(F.col("status") == s).groupBy("recipe_id").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.sum("grams").alias(f"grams_{s}"))
    a, r = of("A"), of("R")
    return (
        a.join(r, "recipe_id", "full_outer")
        .select("recipe_id", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n_A", "long"), ("grams_A", "double"), ("n_R", "long"), ("grams_R", "double"))])
        .withColumn("delta_n", F.col("n_A") - F.col("n_R"))
    )


def j7_recipes_of_one_dish(spark, sf_dir):
    """Foods matched to one brand of line source only: those of several drop out of all."""
    pairs = recipe_lines(spark, sf_dir).select("source_id", "food_id").distinct()
    several = pairs.groupBy("food_id").agg(F.count(F.lit(1)).alias("n")).where("n > 20")
    return pairs.join(several, "food_id", "left_anti")


def j11_token_overlap(spark, sf_dir):
    """Pairs of distinct food names by shared tokens, through an inverted index."""
    names = foods(spark, sf_dir).groupBy("description").agg(F.min("food_id").alias("id"))
    index = names.select("id", F.explode(F.array_distinct(F.split("description", " "))).alias("token"))
    a, b = index.withColumnRenamed("id", "a"), index.withColumnRenamed("id", "b")
    return a.join(b, "token").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def ag5_relational_division(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"))
    return rel.having_all(orders, "cust", "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


def ag7_popular_foods(spark, sf_dir):
    return (
        recipe_lines(spark, sf_dir).groupBy("food_id").agg(F.count_distinct("recipe_id").alias("n_recipes")).where("n_recipes >= 30")
    )


def ag9_value_shares(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def ag10_tier_summary(spark, sf_dir):
    shares = rel.category_shares(recipe_lines(spark, sf_dir), ["recipe_id"], "status", ["A", "N", "R"])
    recipes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"))
    return recipes.join(shares, "recipe_id", "left").select(
        "recipe_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_A", "n_N", "n_R")],
        *[F.round(f"share_{c}", 6).alias(f"share_{c}") for c in "ANR"],
    )


def ag11_score_distribution(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("score"))
    out = rel.distribution(scored, ["segment"], "score", [0.01, 0.05, 0.1, 0.5, 0.9])
    return out.select("segment", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def ag16_rates(spark, sf_dir):
    """Conditional rates per kind and over all, in one pass."""
    lines = table(spark, sf_dir, "lineitem")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return lines.rollup("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("l_quantity") > 25).alias("big_rate"), rate(F.col("l_discount") >= 0.05).alias("discount_rate"), rate(F.col("l_linestatus") == "F").alias("final_rate")
    )


def ag19_modal_portion(spark, sf_dir):
    out = rel.modal_value(recipe_lines(spark, sf_dir), ["food_id"], "grams")
    return out.select("food_id", "modal", F.round("modal_share", 6).alias("modal_share"), "n_rows", "n_distinct")


def ag21_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def ag23_bins(spark, sf_dir):
    """Right-closed bins."""
    total = F.col("o_totalprice")
    label = F.when(total <= 1000, "(0, 1000]").when(total <= 50000, "(1000, 50000]").when(total <= 200000, "(50000, 200000]").otherwise("above")
    return table(spark, sf_dir, "orders").groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ag30_combinations(spark, sf_dir):
    sets = recipe_lines(spark, sf_dir).groupBy("recipe_id").agg(F.array_join(F.array_sort(F.collect_set("status")), "+").alias("statuses"))
    return sets.groupBy("statuses").agg(F.count(F.lit(1)).alias("n"))


def ag31_fully_resolved(spark, sf_dir):
    return recipe_lines(spark, sf_dir).groupBy("recipe_id").agg(F.every(F.col("grams") >= 5).alias("ok")).where("ok").select("recipe_id")


def ag33_wasserstein(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    w, s = F.col("l_quantity"), F.col("l_extendedprice")
    return lines.groupBy("l_returnflag").agg(F.round(F.sum(w * F.abs(s - 30000.0)) / F.sum(w), 4).alias("loss"))


def ag36_robust_scale(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    mid = orders.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("mid"))
    out = orders.join(mid, "o_orderpriority").groupBy("o_orderpriority").agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("o_totalprice") - F.col("mid"))).alias("mad"))
    return out.select("o_orderpriority", F.round("mid", 4).alias("mid"), F.round("mad", 4).alias("mad"))


def ag39_spend_window(spark, sf_dir):
    """Spend of every day and kind of event, and its rate per minute of the day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return events.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("spend"), F.round(F.sum("value") / 1440, 6).alias("per_minute"))


def w2_dedupe_by_name(spark, sf_dir):
    food = foods(spark, sf_dir)
    name = text.normalize_description(F.col("description"))
    key = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("id:"), F.col("food_id").cast("string")))
    return rel.first_per_key(food, [key], [F.desc_nulls_last("size"), F.desc("food_id")]).select("food_id", "description", "size")


def w3_reverse_running_spend(spark, sf_dir):
    """Per user, newest first: the first event at which the running spend reaches 500."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = table(spark, sf_dir, "events").withColumn("spent", F.sum("value").over(newest)).where("spent >= 500")
    return crossed.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def w5_cumulative_share(spark, sf_dir):
    """Running count over all sources, those with most lines first."""
    return w5_cumulative_share_all(spark, sf_dir).drop("percent")


def w5_cumulative_share_all(spark, sf_dir):
    """Cumulative percentage over all sources.  Ranges of 65,536 ids with the same n are summed first;
    one window runs over these totals, the others inside the ranges."""
    counts = recipe_lines(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("source_id") / 65536))
    cells = counts.groupBy("n", "cell").agg(F.sum("n").alias("size"))
    before = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("n").alias("of_n"), F.col("cell").alias("of_cell"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("n", "cell").orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = F.col("start") + F.sum("n").over(inside)
    return (
        counts.join(cells, (F.col("n") == F.col("of_n")) & F.col("cell").eqNullSafe(F.col("of_cell")))
        .withColumn("cumulative", cumulative)
        .select("source_id", "n", "cumulative", F.round(100 * F.col("cumulative") / F.col("total"), 6).alias("percent"))
    )


def w7_match_margin(spark, sf_dir):
    ranked = rel.with_margin(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_totalprice")
    return ranked.where("rank = 1").select("o_custkey", "o_orderkey", F.round("margin", 4).alias("margin"))


def w11_running_header(spark, sf_dir):
    """The last urgent order of a customer, carried forward."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.last(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")), ignorenulls=True).over(order)
    return table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"))


def t2_top_k_or_floor(spark, sf_dir):
    ranked = rel.top_k(table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_extendedprice")), ["l_suppkey"], [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 50)
    return ranked.where("rank <= 15 or score >= 40000").select("l_suppkey", "l_orderkey", "l_partkey", F.col("rank").cast("long").alias("rank"))


def t13_best_band(spark, sf_dir):
    """Per segment the fixed-width band of balances with most customers; the lowest on ties."""
    balances = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    bands = balances.withColumn("low", F.explode(F.sequence(F.lit(-1000), F.lit(9000), F.lit(500)))).where("c_acctbal between low and low + 1000")
    counts = bands.groupBy("c_mktsegment", "low").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("c_mktsegment").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("low"), F.max("n").alias("n"))


def se4_exact_duplicate_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "text")), 256).alias("key"))
    keep = docs.groupBy("key").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(keep, "key").where("doc_id <> keep").select("doc_id", "keep")


def se5_unordered_pairs(spark, sf_dir):
    lines = recipe_lines(spark, sf_dir)
    pairs = lines.select(F.least("food_id", "source_id").alias("lo"), F.greatest("food_id", "source_id").alias("hi"), "grams")
    return pairs.groupBy("lo", "hi").agg(F.max("grams").alias("best"))


def se13_pareto(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    cost = recipe_lines(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source_id", "s_suppkey")
    return rel.pareto_front(suppliers.join(cost, "s_suppkey"), "s_nationkey", "s_suppkey", ["s_acctbal", "n"]).select("s_nationkey", "s_suppkey")


def sk8_merge_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    old, new = rows.where("o_orderstatus <> 'O'"), rows.where("o_custkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0))
    return rel.upsert(old, new, ["o_orderkey"])


def x3_exploded_categories(spark, sf_dir):
    return foods(spark, sf_dir).select(F.explode(F.split("data_type", " ")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def x13_gap_to_best(spark, sf_dir):
    best = F.min("s_acctbal").over(Window.partitionBy("s_nationkey"))
    gap = F.when(F.abs(best) < 1e-9, None).otherwise(100 * (F.col("s_acctbal") - best) / F.abs(best))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(gap, 4).alias("gap"))


def x15_merged_lines(spark, sf_dir):
    """Lines of one food in a recipe as one: summed grams, the heaviest line as template."""
    return recipe_lines(spark, sf_dir).groupBy("recipe_id", "food_id").agg(
        F.sum("grams").alias("grams"), F.max_by("line", F.struct("grams", -F.col("line"))).alias("template"), F.count(F.lit(1)).alias("n")
    )


SQL = {
    "p7_recipe_nutrients": """
SELECT o_orderkey AS recipe_id, o_orderpriority AS kind,
  round(coalesce(sum(CASE WHEN p_size % 4 = 0 THEN p_retailprice * l_quantity / 100 END), 0), 4) AS n0,
  round(coalesce(sum(CASE WHEN p_size % 4 = 1 THEN p_retailprice * l_quantity / 100 END), 0), 4) AS n1,
  round(coalesce(sum(CASE WHEN p_size % 4 = 2 THEN p_retailprice * l_quantity / 100 END), 0), 4) AS n2,
  round(coalesce(sum(CASE WHEN p_size % 4 = 3 THEN p_retailprice * l_quantity / 100 END), 0), 4) AS n3
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "pf1_foods_with_heavy_line": """
SELECT p_partkey AS food_id, p_name AS description FROM part WHERE p_brand <> 'Brand#11'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)
  AND EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'F')""",
    "j3_compare_runs": """
WITH a AS (SELECT l_orderkey k, count(*) n, sum(l_quantity) g FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
r AS (SELECT l_orderkey k, count(*) n, sum(l_quantity) g FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, r.k) AS recipe_id, coalesce(a.n, 0) AS "n_A", coalesce(a.g, 0) AS "grams_A", coalesce(r.n, 0) AS "n_R", coalesce(r.g, 0) AS "grams_R",
  coalesce(a.n, 0) - coalesce(r.n, 0) AS delta_n FROM a FULL JOIN r ON a.k = r.k""",
    "j7_recipes_of_one_dish": """
WITH p AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS food_id FROM lineitem)
SELECT food_id, source_id FROM p WHERE food_id NOT IN (SELECT food_id FROM p GROUP BY 1 HAVING count(*) > 20)""",
    "j11_token_overlap": """
WITH n AS (SELECT p_name, min(p_partkey) id FROM part GROUP BY 1),
i AS (SELECT DISTINCT id, unnest(string_split(p_name, ' ')) token FROM n)
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM i x JOIN i y USING (token) WHERE x.id < y.id GROUP BY 1, 2""",
    "ag5_relational_division": "SELECT o_custkey AS cust FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5",
    "ag7_popular_foods": "SELECT l_partkey AS food_id, count(DISTINCT l_orderkey) AS n_recipes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 30",
    "ag9_value_shares": "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
    "ag10_tier_summary": """
SELECT o_orderkey AS recipe_id, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS "n_A", count(*) FILTER (l_returnflag = 'N') AS "n_N", count(*) FILTER (l_returnflag = 'R') AS "n_R",
  round(count(*) FILTER (l_returnflag = 'A') / nullif(count(l_orderkey), 0), 6) AS "share_A", round(count(*) FILTER (l_returnflag = 'N') / nullif(count(l_orderkey), 0), 6) AS "share_N",
  round(count(*) FILTER (l_returnflag = 'R') / nullif(count(l_orderkey), 0), 6) AS "share_R"
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "ag11_score_distribution": """
SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 4) AS std,
  round(quantile_cont(c_acctbal, 0.01), 4) AS p01, round(quantile_cont(c_acctbal, 0.05), 4) AS p05, round(quantile_cont(c_acctbal, 0.1), 4) AS p10,
  round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1""",
    "ag16_rates": """
SELECT l_returnflag, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS big_rate, round(avg((l_discount >= 0.05)::INT), 6) AS discount_rate,
  round(avg((l_linestatus = 'F')::INT), 6) AS final_rate FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
    "ag19_modal_portion": """
WITH c AS (SELECT l_partkey AS food_id, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT food_id, arg_min(v, [-n, v]) AS modal, round(max(n) / sum(n), 6) AS modal_share, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct FROM c GROUP BY 1""",
    "ag21_crosstab": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ag23_bins": """
SELECT CASE WHEN o_totalprice <= 1000 THEN '(0, 1000]' WHEN o_totalprice <= 50000 THEN '(1000, 50000]' WHEN o_totalprice <= 200000 THEN '(50000, 200000]' ELSE 'above' END AS bin,
  count(*) AS n FROM orders GROUP BY 1""",
    "ag30_combinations": "WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS statuses FROM lineitem GROUP BY 1) SELECT statuses, count(*) AS n FROM s GROUP BY 1",
    "ag31_fully_resolved": "SELECT l_orderkey AS recipe_id FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity >= 5)",
    "ag33_wasserstein": "SELECT l_returnflag, round(sum(l_quantity * abs(l_extendedprice - 30000)) / sum(l_quantity), 4) AS loss FROM lineitem GROUP BY 1",
    "ag36_robust_scale": """
WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS mid FROM orders GROUP BY 1)
SELECT o_orderpriority, round(any_value(mid), 4) AS mid, round(median(abs(o_totalprice - mid)), 4) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1""",
    "ag39_spend_window": """
SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS spend, round(sum(value) / 1440, 6) AS per_minute FROM events GROUP BY 1, 2""",
    "w2_dedupe_by_name": r"""
SELECT food_id, description, size FROM (SELECT p_partkey AS food_id, p_name AS description, p_size AS size, row_number() OVER (
  PARTITION BY coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'id:' || p_partkey)
  ORDER BY p_size DESC NULLS LAST, p_partkey DESC) AS r FROM part) WHERE r = 1""",
    "w3_reverse_running_spend": """
WITH s AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS spent FROM events)
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM s WHERE spent >= 500) WHERE r = 1""",
    "w5_cumulative_share": """
WITH c AS (SELECT l_suppkey AS source_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT source_id, n, sum(n) OVER (ORDER BY n DESC, source_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM c""",
    "w5_cumulative_share_all": """
WITH c AS (SELECT l_suppkey AS source_id, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, source_id ROWS UNBOUNDED PRECEDING) AS cumulative FROM c)
SELECT source_id, n, cumulative::BIGINT AS cumulative, round(100 * cumulative / sum(n) OVER (), 6) AS percent FROM r""",
    "w7_match_margin": """
WITH r AS (SELECT *, row_number() OVER w AS r, o_totalprice - coalesce(lead(o_totalprice) OVER w, 0) AS margin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, round(margin, 4) AS margin FROM r WHERE r = 1""",
    "w11_running_header": """
SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS header FROM orders""",
    "t2_top_k_or_floor": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem)
SELECT l_suppkey, l_orderkey, l_partkey, r AS rank FROM r WHERE r <= 15 OR (r <= 50 AND l_extendedprice >= 40000)""",
    "t13_best_band": """
WITH b AS (SELECT c_mktsegment, low, count(*) AS n FROM customer, (SELECT unnest(range(-1000, 9001, 500))::INT AS low) WHERE c_acctbal BETWEEN low AND low + 1000 GROUP BY 1, 2)
SELECT c_mktsegment, arg_max(low, [n, -low]) AS low, max(n) AS n FROM b GROUP BY 1""",
    "se4_exact_duplicate_ids": """
WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS keep FROM documents) SELECT doc_id, keep FROM k WHERE doc_id <> keep""",
    "se5_unordered_pairs": "SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2",
    "se13_pareto": """
WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)
SELECT s_nationkey, s_suppkey FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
  AND b.s_acctbal <= a.s_acctbal AND b.n <= a.n AND (b.s_acctbal < a.s_acctbal OR b.n < a.n))""",
    "sk8_merge_checkpoint": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O' AND o_custkey % 3 <> 0
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 0.0::DOUBLE FROM orders WHERE o_custkey % 3 = 0""",
    "x3_exploded_categories": "SELECT unnest(string_split(p_type, ' ')) AS category, count(*) AS n FROM part GROUP BY 1",
    "x13_gap_to_best": """
WITH b AS (SELECT *, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS best FROM supplier)
SELECT s_suppkey, CASE WHEN abs(best) < 1e-9 THEN NULL ELSE round(100 * (s_acctbal - best) / abs(best), 4) END AS gap FROM b""",
    "x15_merged_lines": """
SELECT l_orderkey AS recipe_id, l_partkey AS food_id, sum(l_quantity) AS grams, arg_max(l_linenumber, [l_quantity, -l_linenumber]) AS template, count(*) AS n FROM lineitem GROUP BY 1, 2""",
}
QUERIES = {name: globals()[name] for name in SQL}
