"""Filters, joins and run reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.tables import foods, recipe_lines, table

KEY = ["recipe_id", "line", "food_id", "source_id"]

#: Two runs over the same lines: one reached the final ones, the other those with a discount.
RUNS_SQL = """
WITH v1 AS (SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, max(l_quantity) AS score, min(l_returnflag) AS match
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
v2 AS (SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, max(l_quantity + 1000 * l_discount - 50) AS score, max(l_returnflag) AS match
  FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = recipe_lines(spark, sf_dir, more=("l_linestatus", "l_discount"))
    first = lines.where("l_linestatus = 'F'").groupBy(*KEY).agg(F.max("grams").alias("score"), F.min("status").alias("match"))
    second = lines.where("l_discount > 0.03").groupBy(*KEY).agg(F.max(F.expr("grams + 1000 * l_discount - 50")).alias("score"), F.max("status").alias("match"))
    return first, second


def _rate(condition: Column) -> Column:
    """The share of rows for which ``condition`` holds; null counts as not."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)


def all_of(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The rows that meet every condition; None stands for a filter that is not set."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(and_, given)) if given else df


def pf2_foods_in_use(spark, sf_dir):
    return foods(spark, sf_dir).join(recipe_lines(spark, sf_dir), "food_id", "left_semi").select("food_id", "description")


def pf3_listed_foods(spark, sf_dir):
    return recipe_lines(spark, sf_dir).where(F.col("food_id").isin(3, 5, 8, 13, 21, 34)).groupBy("food_id").agg(F.count(F.lit(1)).alias("n"))


def pf4_title_search(spark, sf_dir):
    """Case-insensitive substring; % and _ of the term are ordinary characters."""
    return foods(spark, sf_dir).where(F.contains(F.lower("description"), F.lower(F.lit("D w")))).select("food_id", "description")


def pf5_complete_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), "value").where("k is not null and value is not null")


def pf6_in_macro_box(spark, sf_dir):
    eps = 1e-9
    inside = lambda c, low, high: F.col(c).between(low - eps, high + eps)
    return table(spark, sf_dir, "lineitem").where(inside("l_discount", 0.03, 0.05) & inside("l_tax", 0.02, 0.06)).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


def pf7_valid_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 20 and l_discount >= 0.05 and l_extendedprice >= 30000").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def pf8_counts_in_one_row(spark, sf_dir):
    names = ["region", "nation", "supplier", "part", "customer", "orders"]
    counts = [table(spark, sf_dir, n).select(F.lit(n).alias("name")) for n in names]
    return reduce(DataFrame.unionByName, counts).agg(*[F.count_if(F.col("name") == n).alias(f"n_{n}") for n in names])


def pf9_error_flags(spark, sf_dir):
    flags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in (("big", "l_quantity > 45"), ("cheap", "l_extendedprice < 2000"), ("untaxed", "l_tax = 0"))]))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(flags, "|").alias("flags"))
    return lines.where("flags <> ''").groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


DENIED = ("cold", "rust")


def pf10_not_denied(spark, sf_dir):
    denied = reduce(lambda a, b: a | b, (F.contains(F.lower("description"), F.lit(w)) for w in DENIED))
    return foods(spark, sf_dir).where(~denied).select("food_id")


TAGS = {"no_cold": ("cold", "frozen"), "no_metal": ("brass", "steel", "copper")}


def pf11_tag_violations(spark, sf_dir):
    """Per food the violated tags with the word that breaks them; kept if there are none."""
    text = F.lower(F.concat_ws(" ", "description", "data_type"))
    hits = [F.when(F.contains(text, F.lit(w)), F.lit(f"{tag}:{w}")) for tag, words in TAGS.items() for w in words]
    reasons = F.array_join(F.array_compact(F.array(*hits)), ",")
    return foods(spark, sf_dir).select("food_id", reasons.alias("reasons"), (reasons == "").alias("kept"))


FAMILIES = {"a": ("Brand#11", "Brand#12", "Brand#13"), "b": ("Brand#21", "Brand#22"), "c": ("Brand#31", "Brand#32", "Brand#33")}


def _family(brand: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, brands in FAMILIES.items():
        out = F.when(brand.isin(*brands), name).otherwise(out)
    return out


def pf12_family_clash(spark, sf_dir):
    """Recipes whose foods come from families that do not go together: a with c."""
    families = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).select("food_id", _family(F.col("brand")).alias("family")), "food_id")
    return families.groupBy("recipe_id").agg(F.array_sort(F.collect_set("family")).alias("f")).select(
        "recipe_id", F.array_join("f", "+").alias("families"), (F.array_contains("f", "a") & F.array_contains("f", "c")).alias("clash")
    )


def pf13_optional_filters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status, least, priority = "F", 100000.0, None
    chosen = all_of(orders, F.col("o_orderstatus") == status, F.col("o_totalprice") >= least, F.col("o_orderpriority") == priority if priority else None)
    return chosen.select("o_orderkey")


def pf14_ready_rows(spark, sf_dir):
    ready = (F.col("grams") > 0) & F.col("food_id").isNotNull() & ((F.col("status") != "N") | (F.col("grams") > 10))
    return recipe_lines(spark, sf_dir).withColumn("ready", ready).groupBy("status").agg(F.count_if("ready").alias("n_ready"), F.count(F.lit(1)).alias("n"))


def pf15_merge_without_clash(spark, sf_dir):
    """Columns that both sides have come from the left one."""
    left = foods(spark, sf_dir).select("food_id", "description", "size")
    right = foods(spark, sf_dir).select("food_id", "description", F.upper("brand").alias("brand"), (F.col("size") + 1).alias("size"))
    shared = [c for c in right.columns if c in left.columns and c != "food_id"]
    return left.join(right.drop(*shared), "food_id")


def j4_runs_side_by_side(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    suffixed = lambda df, v: df.select(*KEY, F.col("score").alias(f"score_{v}"), F.col("match").alias(f"match_{v}"))
    both = suffixed(first, "v1").join(suffixed(second, "v2"), KEY, "full_outer")
    return both.withColumn("score_v1", F.round("score_v1", 4)).withColumn("score_v2", F.round("score_v2", 4))


def j5_runs_compared(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    a, b = first.withColumnsRenamed({"score": "s1", "match": "m1"}), second.withColumnsRenamed({"score": "s2", "match": "m2"})
    return a.join(b, KEY).select(*KEY, (F.col("m1") == F.col("m2")).alias("same"), F.round(F.col("s2") - F.col("s1"), 4).alias("delta"))


def j8_dish_lines(spark, sf_dir):
    """customer, order, line, food; without customers who have an urgent order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dish"), F.col("o_orderkey").alias("recipe_id"), "o_orderpriority")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("dish")
    dishes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dish")).join(orders.drop("o_orderpriority"), "dish").join(urgent, "dish", "left_anti")
    return dishes.join(recipe_lines(spark, sf_dir), "recipe_id").join(foods(spark, sf_dir), "food_id").groupBy("dish", "brand").agg(F.count(F.lit(1)).alias("n"))


def j10_pairs_in_recipe(spark, sf_dir):
    """Unordered pairs of the foods of a recipe, counted over recipes; recipes have a few lines."""
    sets = recipe_lines(spark, sf_dir).select("recipe_id", F.pmod("food_id", F.lit(40)).alias("food")).distinct()
    a, b = sets.withColumnRenamed("food", "a"), sets.withColumnRenamed("food", "b")
    return a.join(b, "recipe_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def j12_lookup_with_default(spark, sf_dir):
    known = foods(spark, sf_dir).where("size < 25").select("food_id", "brand")
    return recipe_lines(spark, sf_dir).join(known, "food_id", "left").groupBy(F.coalesce("brand", F.lit("unmapped")).alias("node")).agg(F.count(F.lit(1)).alias("n"))


def j15_bands(spark, sf_dir):
    """Lines in overlapping bands of price, each band as wide as two steps: a line is in at most two."""
    step = 10000
    low = (F.floor(F.col("l_extendedprice") / step) * step).cast("long")
    placed = table(spark, sf_dir, "lineitem").select(F.explode(F.array(low - step, low)).alias("low")).where("low >= 0")
    return placed.groupBy("low").agg(F.count(F.lit(1)).alias("n"))


def j16_cascaded_lookup(spark, sf_dir):
    """The exact name's entry, else its last word's if that is flagged as a stem."""
    food = foods(spark, sf_dir)
    entries = food.where("food_id % 7 = 0").groupBy(F.col("description").alias("name")).agg(F.min("food_id").alias("entry"))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    stems = food.where("size > 45").groupBy(last("description").alias("stem")).agg(F.min("food_id").alias("stem_entry"), F.lit(True).alias("flag"))
    asked = food.select("food_id", F.col("description").alias("name"), last("description").alias("stem"))
    found = asked.join(entries, "name", "left").join(stems, "stem", "left")
    return found.select("food_id", F.coalesce("entry", F.when(F.col("flag"), F.col("stem_entry"))).alias("entry"))


def j17_strictly_better(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    both = first.withColumnsRenamed({"score": "s1", "match": "m1"}).join(second.withColumnsRenamed({"score": "s2", "match": "m2"}), KEY, "left")
    return both.groupBy(F.col("m1").alias("match")).agg(
        F.count(F.lit(1)).alias("n"), F.count("s2").alias("measurable"), F.count_if(F.col("s2") > F.col("s1")).alias("better"), F.count_if(F.col("s2") == F.col("s1")).alias("equal")
    )


def j18_baskets_with_core(spark, sf_dir):
    """Brands that stand beside all core brands, and the share of such baskets that hold them."""
    core = ["Brand#11", "Brand#12"]
    items = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).select("food_id", "brand"), "food_id").select("recipe_id", "brand").distinct()
    baskets = items.where(F.col("brand").isin(core)).groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(core)).select("recipe_id")
    total = baskets.agg(F.count(F.lit(1)).alias("baskets"))
    with_core = items.join(baskets, "recipe_id", "left_semi").where(~F.col("brand").isin(core)).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return with_core.join(F.broadcast(total)).select("brand", "n", F.round(F.col("n") / F.col("baskets"), 6).alias("share"))


def ag3_pivot_first(spark, sf_dir):
    """Per food and status the amount of its least line; deterministic by line and recipe."""
    by = F.struct("recipe_id", "line", "source_id", "grams")
    return recipe_lines(spark, sf_dir).groupBy("food_id").pivot("status", ["A", "N", "R"]).agg(F.min_by("grams", by))


def ag4_pivot_complete(spark, sf_dir):
    return recipe_lines(spark, sf_dir).groupBy("recipe_id").pivot("status", ["A", "R"]).agg(F.sum("grams")).dropna()


def ag6_all_kinds_in_use(spark, sf_dir):
    kinds = recipe_lines(spark, sf_dir).groupBy("food_id").agg(F.count_distinct("status").alias("n")).where("n = 3")
    heavy = recipe_lines(spark, sf_dir).where("grams >= 50")
    return kinds.join(heavy, "food_id", "left_semi").select("food_id")


def ag7_top_dishes(spark, sf_dir):
    """The ten most ordered foods with at least 20 recipes; a top-k report."""
    counts = recipe_lines(spark, sf_dir).groupBy("food_id").agg(F.count_distinct("recipe_id").alias("n_recipes")).where("n_recipes >= 20")
    return counts.orderBy(F.desc("n_recipes"), "food_id").limit(10)


def ag8_count_of_popular(spark, sf_dir):
    return recipe_lines(spark, sf_dir).groupBy("food_id").agg(F.count_distinct("recipe_id").alias("n")).where("n >= 25").agg(F.count(F.lit(1)).alias("n_foods"))


def ag12_metrics_side_by_side(spark, sf_dir):
    def metrics(df, name):
        one = df.agg(F.count(F.lit(1)).cast("double").alias("lines"), F.avg("score").alias("mean_score"), _rate(F.col("match") == "A").alias("share_a"))
        return one.unpivot([], ["lines", "mean_score", "share_a"], "metric", name)

    first, second = _runs(spark, sf_dir)
    return metrics(first, "v1").join(metrics(second, "v2"), "metric").select(
        "metric", F.round("v1", 4).alias("v1"), F.round("v2", 4).alias("v2"), F.round(F.col("v2") - F.col("v1"), 4).alias("delta")
    )


def ag13_match_comparison(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    both = first.withColumnsRenamed({"score": "s1", "match": "m1"}).join(second.withColumnsRenamed({"score": "s2", "match": "m2"}), KEY)
    return both.agg(
        F.count(F.lit(1)).alias("n"), _rate((F.col("m1") != "N") & (F.col("m2") != "N")).alias("both_resolved"),
        _rate(F.col("m1") == F.col("m2")).alias("same_match"), _rate(F.col("s2") > F.col("s1")).alias("second_higher"),
    )


def ag14_all_but_one(spark, sf_dir):
    """Recipes with at most one unresolved line in either run, fewest first."""
    first, second = _runs(spark, sf_dir)
    open_lines = lambda df, n: df.groupBy("recipe_id").agg(F.count_if(F.col("match") == "N").alias(n), F.count(F.lit(1)).alias(f"lines_{n}"))
    both = open_lines(first, "open_1").join(open_lines(second, "open_2"), "recipe_id").where("least(open_1, open_2) <= 1")
    return both.orderBy(F.least("open_1", "open_2"), F.desc("lines_open_1"), "recipe_id")


def ag15_run_report(spark, sf_dir):
    q = lambda p: F.round(F.percentile("value", p), 4)
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), _rate(F.col("event_type") == "error").alias("error_rate"),
        q(0.01).alias("p01"), q(0.05).alias("p05"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.sum("value") * 0.4 / 1e6, 8).alias("cost"),
    )


RATES = {
    "big": "l_quantity > 25", "huge": "l_quantity >= 45", "small": "l_quantity <= 5", "discounted": "l_discount > 0", "deep": "l_discount >= 0.08", "taxed": "l_tax > 0", "high_tax": "l_tax >= 0.06",
    "final": "l_linestatus = 'F'", "open": "l_linestatus = 'O'", "first_line": "l_linenumber = 1", "late_line": "l_linenumber >= 5", "dear": "l_extendedprice > 50000", "cheap": "l_extendedprice < 5000",
    "even_food": "l_partkey % 2 = 0", "big_discounted": "l_quantity > 25 and l_discount > 0.05", "big_final": "l_quantity > 25 and l_linestatus = 'F'", "dear_taxed": "l_extendedprice > 50000 and l_tax > 0.04",
    "untaxed_small": "l_quantity <= 5 and l_tax = 0", "mid": "l_quantity between 20 and 30", "no_reduction": "l_discount = 0 and l_tax = 0", "any_extreme": "l_quantity >= 48 or l_discount >= 0.1",
}


def ag16_feasibility_rates(spark, sf_dir):
    """21 rates in one pass, per kind and over all; an over-all rate of the big lines beside them."""
    big_final = F.round(F.try_divide(F.count_if(F.expr("l_quantity > 25 and l_linestatus = 'F'")), F.count_if(F.expr("l_quantity > 25"))), 6)
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[_rate(F.expr(c)).alias(f"{n}_rate") for n, c in RATES.items()], big_final.alias("final_of_big")
    )


def ag17_parse_report(spark, sf_dir):
    """Coverage of a parser: how many lines of text have a number, a unit, both; by speaker role."""
    text = F.lower(F.coalesce("text", F.lit("")))
    number, comma = text.rlike("[0-9]"), F.contains(text, F.lit(","))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), _rate(number).alias("number_rate"), _rate(comma).alias("comma_rate"), _rate(number & comma).alias("both_rate"), F.round(F.avg(F.length(text)), 4).alias("mean_chars")
    )


def ag18_run_agreement(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    both = first.withColumnsRenamed({"score": "s1", "match": "m1"}).join(second.withColumnsRenamed({"score": "s2", "match": "m2"}), KEY, "full_outer")
    seen = lambda c: F.col(c).isNotNull() & (F.col(c) != "N")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("m1") == F.col("m2")).alias("agree"), F.count_if(~seen("m1") & seen("m2")).alias("newly"), F.count_if(seen("m1") & ~seen("m2")).alias("lost")
    )


def ag20_eligible_keys(spark, sf_dir):
    """Foods with ten lines or more of which one status has at least half, without the sentinel."""
    counts = recipe_lines(spark, sf_dir).where("food_id <> 13").groupBy("food_id", "status").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("food_id").agg(F.sum("n").alias("lines"), F.max("n").alias("most"))
    return modal.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.expr("lines >= 10 and most >= 0.5 * lines")).alias("eligible"), _rate(F.expr("lines >= 10 and most >= 0.5 * lines")).alias("rate"))


def ag22_domain_stats(spark, sf_dir):
    """Rates of lines and of recipes per source, joined; sources with 40 lines or more."""
    lines = recipe_lines(spark, sf_dir)
    fine = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_lines"), _rate(F.col("status") == "N").alias("line_rate"))
    per_recipe = lines.groupBy("source_id", "recipe_id").agg(F.every(F.col("status") == "N").alias("ok"))
    coarse = per_recipe.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_recipes"), _rate(F.col("ok")).alias("recipe_rate"))
    return fine.where("n_lines >= 40").join(coarse, "source_id")


def ag26_mass_shares(spark, sf_dir):
    """Per recipe and brand the share of all its grams, those of unmapped foods included."""
    lines = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).where("size <= 40").select("food_id", "brand"), "food_id", "left")
    total = F.sum("grams").over(Window.partitionBy("recipe_id"))
    by_node = lines.groupBy("recipe_id", "brand").agg(F.sum("grams").alias("grams"))
    return by_node.withColumn("share", F.round(F.col("grams") / total, 6)).where("brand is not null").select("recipe_id", "brand", "share")


def _fractions(spark, sf_dir) -> DataFrame:
    grams = lambda s: F.sum(F.when(F.col("status") == s, F.col("grams")).otherwise(0.0))
    sums = recipe_lines(spark, sf_dir).groupBy("recipe_id", "source_id").agg(grams("A").alias("p"), grams("N").alias("c"), grams("R").alias("f"))
    energy = F.expr("4 * p + 4 * c + 9 * f")
    return sums.withColumn("kcal", energy).where("kcal > 0").select("recipe_id", "source_id", *[(w * F.col(x) / F.col("kcal")).alias(x) for x, w in (("p", 4), ("c", 4), ("f", 9))])


def ag27_energy_fractions(spark, sf_dir):
    return _fractions(spark, sf_dir).select("recipe_id", "source_id", *[F.round(x, 6).alias(x) for x in "pcf"])


def ag28_median_fractions(spark, sf_dir):
    return _fractions(spark, sf_dir).groupBy("source_id").agg(*[F.round(F.median(x), 6).alias(x) for x in "pcf"])


def ag32_mean_pairwise_jaccard(spark, sf_dir):
    """Mean Jaccard of the status sets of a customer's orders; one order alone gives 1.

    Orders with equal sets are counted, so pairs are taken of distinct sets only, seven at most."""
    sets = recipe_lines(spark, sf_dir).groupBy("recipe_id").agg(F.array_sort(F.collect_set("status")).alias("s"))
    owned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"), "o_custkey").join(sets, "recipe_id").groupBy("o_custkey", "s").agg(F.count(F.lit(1)).alias("n"))
    a, b = owned.withColumnsRenamed({"s": "x", "n": "nx"}), owned.withColumnsRenamed({"s": "y", "n": "ny"})
    both = a.join(b, "o_custkey").where("x <= y")
    ways = F.when(F.col("x") == F.col("y"), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny"))
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    means = both.groupBy("o_custkey").agg(F.sum(ways).alias("w"), F.sum(ways * jaccard).alias("s"))
    return means.select("o_custkey", F.round(F.coalesce(F.try_divide("s", "w"), F.lit(1.0)), 6).alias("mean_jaccard"))


def ag35_in_band_fraction(spark, sf_dir):
    """Energy-weighted share of a recipe's foods whose grams lie in the food's quartiles; each food once."""
    lines = recipe_lines(spark, sf_dir).groupBy("recipe_id", "food_id").agg(F.sum("grams").alias("grams"), F.max("grams").alias("weight"))
    band = lines.groupBy("food_id").agg(F.percentile("grams", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    placed = lines.join(band, "food_id")
    inside = F.col("grams").between(F.col("q")[0], F.col("q")[1])
    return placed.groupBy("recipe_id").agg(F.round(F.sum(F.when(inside, F.col("weight")).otherwise(0.0)) / F.sum("weight"), 6).alias("in_band"))


def ag37_wins_per_mode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    best = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("wins"))
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("runs")).join(best, "event_type", "left").na.fill(0, ["wins"])


def ag38_paired_wins(spark, sf_dir):
    """Of users with two modes or more: which mode has the least and which the greatest value."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    modes = per.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_type", F.struct("low", "event_type")).alias("least"), F.max_by("event_type", F.struct("high", "event_type")).alias("greatest"))
    return modes.where("n >= 2").groupBy("least", "greatest").agg(F.count(F.lit(1)).alias("n"))


def ag39_rolling_spend(spark, sf_dir):
    """Per user and event the spend of the 24 hours up to it, and its rate per minute."""
    day = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-86_400_000_000, 0)
    e = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("spend", F.sum("value").over(day)).select("event_id", F.round("spend", 2).alias("spend"), (F.round("spend", 2) / 1440).alias("per_minute"))


def ag42_basis_hits(spark, sf_dir):
    lines = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).where("size <= 40").select("food_id", "brand"), "food_id", "left")
    return lines.groupBy("source_id").agg(
        F.count_distinct("brand").alias("nodes"), F.count_if(F.col("brand").isNull()).alias("unmapped"), F.count_distinct(F.when(F.col("brand").isNotNull(), F.col("recipe_id"))).alias("recipes")
    )


_JOINED = RUNS_SQL + ", b AS (SELECT v1.*, v2.score AS s2, v2.match AS m2 FROM v1 {how} JOIN v2 USING (recipe_id, line, food_id, source_id))"
_FRACTIONS = """
WITH s AS (SELECT l_orderkey AS recipe_id, l_suppkey AS source_id, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS p, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS c,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS f FROM lineitem GROUP BY ALL),
x AS (SELECT recipe_id, source_id, 4 * p / (4 * p + 4 * c + 9 * f) AS p, 4 * c / (4 * p + 4 * c + 9 * f) AS c, 9 * f / (4 * p + 4 * c + 9 * f) AS f FROM s WHERE 4 * p + 4 * c + 9 * f > 0)"""

SQL = {
    "pf2_foods_in_use": "SELECT p_partkey AS food_id, p_name AS description FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    "pf3_listed_foods": "SELECT l_partkey AS food_id, count(*) AS n FROM lineitem WHERE l_partkey IN (3, 5, 8, 13, 21, 34) GROUP BY 1",
    "pf4_title_search": "SELECT p_partkey AS food_id, p_name AS description FROM part WHERE p_name ILIKE '%d w%'",
    "pf5_complete_events": "SELECT event_id, (props->>'$.k')::BIGINT AS k, value FROM events WHERE props->>'$.k' IS NOT NULL AND value IS NOT NULL",
    "pf6_in_macro_box": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.03 - 1e-9 AND 0.05 + 1e-9 AND l_tax BETWEEN 0.02 - 1e-9 AND 0.06 + 1e-9 GROUP BY 1",
    "pf7_valid_pairs": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 20 AND l_discount >= 0.05 AND l_extendedprice >= 30000 GROUP BY 1",
    "pf8_counts_in_one_row": "SELECT (SELECT count(*) FROM region) AS n_region, (SELECT count(*) FROM nation) AS n_nation, (SELECT count(*) FROM supplier) AS n_supplier, (SELECT count(*) FROM part) AS n_part, (SELECT count(*) FROM customer) AS n_customer, (SELECT count(*) FROM orders) AS n_orders",
    "pf9_error_flags": """
SELECT flags, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN l_quantity > 45 THEN 'big' END, CASE WHEN l_extendedprice < 2000 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS flags FROM lineitem) WHERE flags <> '' GROUP BY 1""",
    "pf10_not_denied": "SELECT p_partkey AS food_id FROM part WHERE NOT regexp_matches(lower(p_name), 'cold|rust')",
    "pf11_tag_violations": """
WITH t AS (SELECT p_partkey AS food_id, lower(p_name || ' ' || p_type) AS t FROM part),
r AS (SELECT food_id, concat_ws(',', CASE WHEN contains(t, 'cold') THEN 'no_cold:cold' END, CASE WHEN contains(t, 'frozen') THEN 'no_cold:frozen' END, CASE WHEN contains(t, 'brass') THEN 'no_metal:brass' END,
  CASE WHEN contains(t, 'steel') THEN 'no_metal:steel' END, CASE WHEN contains(t, 'copper') THEN 'no_metal:copper' END) AS reasons FROM t)
SELECT food_id, reasons, reasons = '' AS kept FROM r""",
    "pf12_family_clash": """
WITH f AS (SELECT DISTINCT l_orderkey AS recipe_id, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'a' WHEN p_brand IN ('Brand#21', 'Brand#22') THEN 'b' WHEN p_brand IN ('Brand#31', 'Brand#32', 'Brand#33') THEN 'c' END AS f
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT recipe_id, coalesce(string_agg(f, '+' ORDER BY f), '') AS families, count(*) FILTER (f = 'a') > 0 AND count(*) FILTER (f = 'c') > 0 AS clash FROM f GROUP BY 1""",
    "pf13_optional_filters": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000",
    "pf14_ready_rows": "SELECT l_returnflag AS status, count(*) FILTER (l_quantity > 0 AND (l_returnflag <> 'N' OR l_quantity > 10)) AS n_ready, count(*) AS n FROM lineitem GROUP BY 1",
    "pf15_merge_without_clash": "SELECT p_partkey AS food_id, p_name AS description, p_size AS size, upper(p_brand) AS brand FROM part",
    "j4_runs_side_by_side": RUNS_SQL + """
SELECT recipe_id, line, food_id, source_id, round(v1.score, 4) AS score_v1, v1.match AS match_v1, round(v2.score, 4) AS score_v2, v2.match AS match_v2 FROM v1 FULL JOIN v2 USING (recipe_id, line, food_id, source_id)""",
    "j5_runs_compared": _JOINED.format(how="") + " SELECT recipe_id, line, food_id, source_id, match = m2 AS same, round(s2 - score, 4) AS delta FROM b",
    "j8_dish_lines": """
SELECT c_custkey AS dish, p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2""",
    "j10_pairs_in_recipe": """
WITH s AS (SELECT DISTINCT l_orderkey AS r, l_partkey % 40 AS food FROM lineitem) SELECT x.food AS a, y.food AS b, count(*) AS n FROM s x JOIN s y ON x.r = y.r AND x.food < y.food GROUP BY 1, 2""",
    "j12_lookup_with_default": "SELECT coalesce(p_brand, 'unmapped') AS node, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25 GROUP BY 1",
    "j15_bands": """
SELECT low, count(*) AS n FROM lineitem JOIN (SELECT unnest(range(0, 2000000, 10000)) AS low) ON l_extendedprice >= low AND l_extendedprice < low + 20000 GROUP BY 1""",
    "j16_cascaded_lookup": """
WITH e AS (SELECT p_name, min(p_partkey) AS entry FROM part WHERE p_partkey % 7 = 0 GROUP BY 1), s AS (SELECT string_split(p_name, ' ')[-1] AS stem, min(p_partkey) AS stem_entry FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p_partkey AS food_id, coalesce(entry, stem_entry) AS entry FROM part LEFT JOIN e USING (p_name) LEFT JOIN s ON stem = string_split(p_name, ' ')[-1]""",
    "j17_strictly_better": _JOINED.format(how="LEFT") + " SELECT match, count(*) AS n, count(s2) AS measurable, count(*) FILTER (s2 > score) AS better, count(*) FILTER (s2 = score) AS equal FROM b GROUP BY 1",
    "j18_baskets_with_core": """
WITH i AS (SELECT DISTINCT l_orderkey AS r, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT r FROM i WHERE brand IN ('Brand#11', 'Brand#12') GROUP BY 1 HAVING count(*) = 2)
SELECT brand, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM i WHERE r IN (SELECT r FROM b) AND brand NOT IN ('Brand#11', 'Brand#12') GROUP BY 1""",
    "ag3_pivot_first": """
SELECT l_partkey AS food_id, arg_min(l_quantity, [l_orderkey, l_linenumber, l_suppkey, l_quantity]) FILTER (l_returnflag = 'A') AS "A", arg_min(l_quantity, [l_orderkey, l_linenumber, l_suppkey, l_quantity]) FILTER (l_returnflag = 'N') AS "N",
  arg_min(l_quantity, [l_orderkey, l_linenumber, l_suppkey, l_quantity]) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""",
    "ag4_pivot_complete": """
SELECT l_orderkey AS recipe_id, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1 HAVING "A" IS NOT NULL AND "R" IS NOT NULL""",
    "ag6_all_kinds_in_use": "SELECT l_partkey AS food_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3 AND max(l_quantity) >= 50",
    "ag7_top_dishes": "SELECT l_partkey AS food_id, count(DISTINCT l_orderkey) AS n_recipes FROM lineitem GROUP BY 1 HAVING n_recipes >= 20 ORDER BY n_recipes DESC, food_id LIMIT 10",
    "ag8_count_of_popular": "SELECT count(*) AS n_foods FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 25)",
    "ag12_metrics_side_by_side": RUNS_SQL + """,
m AS (SELECT 'lines' AS metric, (SELECT count(*) FROM v1)::DOUBLE AS v1, (SELECT count(*) FROM v2)::DOUBLE AS v2 UNION ALL SELECT 'mean_score', (SELECT avg(score) FROM v1), (SELECT avg(score) FROM v2)
  UNION ALL SELECT 'share_a', (SELECT round(avg((match = 'A')::INT), 6) FROM v1), (SELECT round(avg((match = 'A')::INT), 6) FROM v2))
SELECT metric, round(v1, 4) AS v1, round(v2, 4) AS v2, round(v2 - v1, 4) AS delta FROM m""",
    "ag13_match_comparison": _JOINED.format(how="") + """
SELECT count(*) AS n, round(avg((match <> 'N' AND m2 <> 'N')::INT), 6) AS both_resolved, round(avg((match = m2)::INT), 6) AS same_match, round(avg((s2 > score)::INT), 6) AS second_higher FROM b""",
    "ag14_all_but_one": RUNS_SQL + """,
o1 AS (SELECT recipe_id, count(*) FILTER (match = 'N') AS open_1, count(*) AS lines_open_1 FROM v1 GROUP BY 1), o2 AS (SELECT recipe_id, count(*) FILTER (match = 'N') AS open_2, count(*) AS lines_open_2 FROM v2 GROUP BY 1)
SELECT * FROM o1 JOIN o2 USING (recipe_id) WHERE least(open_1, open_2) <= 1""",
    "ag15_run_report": """
SELECT count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg((event_type = 'error')::INT), 6) AS error_rate, round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.05), 4) AS p05,
  round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(sum(value) * 0.4 / 1e6, 8) AS cost FROM events""",
    "ag16_feasibility_rates": "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(avg(({c})::INT), 6) AS {n}_rate" for n, c in RATES.items()) + """,
  round(count(*) FILTER (l_quantity > 25 AND l_linestatus = 'F') / nullif(count(*) FILTER (l_quantity > 25), 0), 6) AS final_of_big FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
    "ag17_parse_report": """
SELECT role, count(*) AS n, round(avg(regexp_matches(coalesce(text, ''), '[0-9]')::INT), 6) AS number_rate, round(avg(contains(coalesce(text, ''), ',')::INT), 6) AS comma_rate,
  round(avg((regexp_matches(coalesce(text, ''), '[0-9]') AND contains(coalesce(text, ''), ','))::INT), 6) AS both_rate, round(avg(length(lower(coalesce(text, '')))), 4) AS mean_chars FROM conversations GROUP BY 1""",
    "ag18_run_agreement": RUNS_SQL + """, b AS (SELECT v1.match AS m1, v2.match AS m2 FROM v1 FULL JOIN v2 USING (recipe_id, line, food_id, source_id))
SELECT count(*) AS n, count(*) FILTER (m1 = m2) AS agree, count(*) FILTER (coalesce(m1, 'N') = 'N' AND coalesce(m2, 'N') <> 'N') AS newly, count(*) FILTER (coalesce(m1, 'N') <> 'N' AND coalesce(m2, 'N') = 'N') AS lost FROM b""",
    "ag20_eligible_keys": """
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey <> 13 GROUP BY 1, 2), m AS (SELECT sum(n) AS lines, max(n) AS most FROM c GROUP BY l_partkey)
SELECT count(*) AS keys, count(*) FILTER (lines >= 10 AND most >= 0.5 * lines) AS eligible, round(avg((lines >= 10 AND most >= 0.5 * lines)::INT), 6) AS rate FROM m""",
    "ag22_domain_stats": """
WITH f AS (SELECT l_suppkey AS source_id, count(*) AS n_lines, round(avg((l_returnflag = 'N')::INT), 6) AS line_rate FROM lineitem GROUP BY 1 HAVING n_lines >= 40),
p AS (SELECT l_suppkey AS source_id, l_orderkey, bool_and(l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1, 2), c AS (SELECT source_id, count(*) AS n_recipes, round(avg(ok::INT), 6) AS recipe_rate FROM p GROUP BY 1)
SELECT * FROM f JOIN c USING (source_id)""",
    "ag26_mass_shares": """
WITH g AS (SELECT l_orderkey AS recipe_id, p_brand AS brand, sum(l_quantity) AS g FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 GROUP BY 1, 2),
s AS (SELECT recipe_id, brand, round(g / sum(g) OVER (PARTITION BY recipe_id), 6) AS share FROM g) SELECT * FROM s WHERE brand IS NOT NULL""",
    "ag27_energy_fractions": _FRACTIONS + " SELECT recipe_id, source_id, round(p, 6) AS p, round(c, 6) AS c, round(f, 6) AS f FROM x",
    "ag28_median_fractions": _FRACTIONS + " SELECT source_id, round(median(p), 6) AS p, round(median(c), 6) AS c, round(median(f), 6) AS f FROM x GROUP BY 1",
    "ag32_mean_pairwise_jaccard": """
WITH s AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT x.o_custkey, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS j FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey)
SELECT o_custkey, round(coalesce(avg(j), 1), 6) AS mean_jaccard FROM (SELECT DISTINCT o_custkey FROM s) LEFT JOIN p USING (o_custkey) GROUP BY 1""",
    "ag35_in_band_fraction": """
WITH g AS (SELECT l_orderkey AS recipe_id, l_partkey AS food_id, sum(l_quantity) AS grams, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
q AS (SELECT food_id, quantile_cont(grams, 0.25) AS lo, quantile_cont(grams, 0.75) AS hi FROM g GROUP BY 1)
SELECT recipe_id, round(sum(CASE WHEN grams BETWEEN lo AND hi THEN weight ELSE 0 END) / sum(weight), 6) AS in_band FROM g JOIN q USING (food_id) GROUP BY 1""",
    "ag37_wins_per_mode": """
WITH b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events), w AS (SELECT event_type, count(*) AS wins FROM b WHERE r = 1 GROUP BY 1)
SELECT event_type, round(avg(value), 4) AS mean, count(*) AS runs, coalesce(any_value(wins), 0) AS wins FROM events LEFT JOIN w USING (event_type) GROUP BY 1""",
    "ag38_paired_wins": """
WITH p AS (SELECT user_id, event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY low, event_type) AS a, row_number() OVER (PARTITION BY user_id ORDER BY high DESC, event_type DESC) AS b FROM p)
SELECT least, greatest, count(*) AS n FROM (SELECT user_id, max(event_type) FILTER (a = 1) AS least, max(event_type) FILTER (b = 1) AS greatest FROM r GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2""",
    "ag39_rolling_spend": """
WITH s AS (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS s FROM events) SELECT event_id, round(s, 2) AS spend, round(s, 2) / 1440 AS per_minute FROM s""",
    "ag42_basis_hits": """
SELECT l_suppkey AS source_id, count(DISTINCT p_brand) AS nodes, count(*) FILTER (p_brand IS NULL) AS unmapped, count(DISTINCT l_orderkey) FILTER (p_brand IS NOT NULL) AS recipes
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
