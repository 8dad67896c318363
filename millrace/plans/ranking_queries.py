"""Windows, top-k, sampling, set operators and the ontology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import hierarchy, relational as rel
from millrace.operators.lineage import stored
from millrace.plans.tables import foods, leaf, ontology, recipe_lines, table


def w1_named_first(spark, sf_dir):
    """One food per normalised name: economy types first, then the greatest size, then the greatest id."""
    order = [F.when(F.col("data_type") == "ECONOMY", 0).otherwise(1), F.desc_nulls_last("size"), F.desc("food_id")]
    return rel.first_per_key(foods(spark, sf_dir), [text.normalize_description(F.col("description"))], order).select("food_id", "description")


def w4_line_index(spark, sf_dir):
    order = Window.partitionBy("recipe_id").orderBy("line", "food_id", "source_id", "grams")
    return recipe_lines(spark, sf_dir).select("recipe_id", "line", "food_id", "source_id", (F.row_number().over(order) - 1).alias("idx"))


def w6_lead_difference(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(order), 4).alias("margin"))


def w8_rank_by_many_keys(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(order).cast("long").alias("rank"))


def w9_later_copies(spark, sf_dir):
    """Documents whose language and text an earlier id has."""
    key = F.sha2(F.to_json(F.struct("lang", "text")), 256)
    marked = table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(Window.partitionBy(key).orderBy("doc_id")).alias("n"))
    return marked.where("n > 1").select("doc_id")


def w10_latest_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.value")


def w12_pool_leaders(spark, sf_dir):
    """Per segment the customer nearest to a balance of 5000."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - 5000), "c_custkey")).alias("leader"))


def t3_top_or_above(spark, sf_dir):
    ranked = rel.with_margin(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_totalprice")
    return ranked.where("rank <= 3 or o_totalprice >= 300000").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def t4_mixed_sort(spark, sf_dir):
    """The first hundred orders by status up, price down, key up; a top-k report."""
    return table(spark, sf_dir, "orders").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_totalprice")


def t5_largest(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


def _draw(*parts: Column | str) -> Column:
    """A number from 0 to 1 that depends on the parts alone: the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def t6_seeded_sample(spark, sf_dir):
    """200 orders in the order of a seeded draw; a sampling operator."""
    return table(spark, sf_dir, "orders").select("o_orderkey", _draw(F.lit("17"), "o_orderkey").alias("draw")).orderBy("draw", "o_orderkey").limit(200).select("o_orderkey")


def t7_weighted_sample(spark, sf_dir):
    """Five customers per segment without replacement, the weight is the root of their orders."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    drawn = table(spark, sf_dir, "customer").join(n, "c_custkey").withColumn("key", -F.log(_draw(F.lit("5"), "c_custkey") + 1e-12) / F.sqrt("n"))
    return rel.top_k(drawn, ["c_mktsegment"], [F.asc("key"), F.asc("c_custkey")], 5).select("c_mktsegment", "c_custkey")


def t10_three_tiers(spark, sf_dir):
    """Up to three rare foods of a brand, then five large ones, then a top-up to ten by id."""
    n = recipe_lines(spark, sf_dir).groupBy("food_id").agg(F.count(F.lit(1)).alias("n"))
    food = foods(spark, sf_dir).join(n, "food_id", "left").select("food_id", "brand", "size", F.coalesce("n", F.lit(0)).alias("n"))
    rare = rel.top_k(food, ["brand"], [F.asc("n"), F.asc("food_id")], 3).select("food_id", "brand", F.lit("rare").alias("tier"))
    left = food.join(rare, "food_id", "left_anti")
    large = rel.top_k(left, ["brand"], [F.desc("size"), F.asc("food_id")], 5).select("food_id", "brand", F.lit("large").alias("tier"))
    taken = rare.unionByName(large)
    have = taken.groupBy("brand").agg(F.count(F.lit(1)).alias("have"))
    rest = rel.top_k(food.join(taken, "food_id", "left_anti"), ["brand"], [F.asc("food_id")], 10).join(have, "brand").where("rank <= 10 - have")
    return taken.unionByName(rest.select("food_id", "brand", F.lit("top-up").alias("tier")))


def t12_viable_swap(spark, sf_dir):
    """Per source the ten heaviest lines with at least seven of status A, if it has as many: the last
    others give way to the next of status A."""
    lines = recipe_lines(spark, sf_dir)
    order = [F.desc("grams"), F.asc("recipe_id"), F.asc("line"), F.asc("food_id")]
    every = Window.partitionBy("source_id").orderBy(*order)
    kind = Window.partitionBy("source_id", "viable").orderBy(*order)
    ranked = lines.withColumn("viable", F.col("status") == "A").withColumn("place", F.row_number().over(every)).withColumn("among", F.row_number().over(kind))
    count = ranked.groupBy("source_id").agg(F.count_if(F.expr("viable and place <= 10")).alias("inside"), F.count_if("viable").alias("all_viable"))
    wanted = F.greatest(F.col("inside"), F.least(F.lit(7), F.col("all_viable")))
    kept = ranked.join(count, "source_id").where(F.when(F.col("viable"), F.col("among") <= wanted).otherwise(F.col("among") <= 10 - wanted))
    return kept.select("source_id", "recipe_id", "line", "food_id", "viable")


def t13_best_band_median(spark, sf_dir):
    """Per segment the band of balances, 1000 wide in steps of 500, with most customers; of ties the
    median one (the lower of two)."""
    step = F.floor(F.col("c_acctbal") / 500) * 500
    # a balance lies in the bands that start at or up to 1000 below it: two, or three on an edge
    low = F.filter(F.array(step, step - 500, step - 1000), lambda x: F.col("c_acctbal") <= x + 1000)
    counts = table(spark, sf_dir, "customer").select("c_mktsegment", F.explode(low).alias("low")).withColumn("low", F.col("low").cast("int")).where("low between -1000 and 9000").groupBy("c_mktsegment", "low").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c_mktsegment").agg(F.max("n").alias("n"))
    ties = counts.join(best, ["c_mktsegment", "n"]).groupBy("c_mktsegment", "n").agg(F.array_sort(F.collect_list("low")).alias("lows"))
    return ties.select("c_mktsegment", F.expr("lows[cast((size(lows) - 1) div 2 as int)]").alias("low"), "n")


def se1_union_of_counts(spark, sf_dir):
    names = ["customer", "supplier", "part", "orders", "lineitem"]
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def se2_core_and_shell(spark, sf_dir):
    core = recipe_lines(spark, sf_dir).where("source_id = 3").withColumn("weight", F.lit(1.0))
    shell = recipe_lines(spark, sf_dir).where("source_id = 5").select("recipe_id", "food_id", "grams", F.lit(0.5).alias("weight"))
    shared = [c for c in core.columns if c in shell.columns]
    return core.select(shared).unionByName(shell.select(shared))


def se3_id_sets(spark, sf_dir):
    a = recipe_lines(spark, sf_dir).where("status = 'A'").select("food_id")
    r = recipe_lines(spark, sf_dir).where("status = 'R' and grams > 40").select("food_id")
    return a.intersect(r).withColumn("part", F.lit("both")).unionByName(a.distinct().join(r, "food_id", "left_anti").withColumn("part", F.lit("only")))


def _name_links(spark, sf_dir) -> DataFrame:
    """Customers that ordered at the same time as another: links over shared days of dear orders."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 380000").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    first = orders.groupBy("day").agg(F.min("o_custkey").alias("a"))
    return orders.join(first, "day").select("a", F.col("o_custkey").alias("b")).where("a <> b").distinct()


def se6_components(spark, sf_dir):
    return hierarchy.components(_name_links(spark, sf_dir))


def se7_keepers(spark, sf_dir):
    """Of each component the customer with most orders, then the greatest balance, then the least id."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    rows = hierarchy.components(_name_links(spark, sf_dir)).join(n, "node").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_acctbal"), "node")
    return rows.groupBy("component").agg(F.min_by("node", F.struct(-F.col("n"), -F.col("c_acctbal"), "node")).alias("keeper"), F.count(F.lit(1)).alias("size"))


def se8_signature_dedup(spark, sf_dir):
    """The cheapest food of each token set; listed ids stay besides."""
    food = foods(spark, sf_dir).withColumn("signature", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("description"), " "))), " "))
    best = food.groupBy("signature").agg(F.min_by("food_id", F.struct("amount", "food_id")).alias("food_id"))
    listed = food.where(F.col("food_id").isin(7, 77, 177))
    return best.select("food_id").union(listed.select("food_id")).distinct()


def se9_recipes_in_use(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(recipe_lines(spark, sf_dir).where("grams > 45").withColumnRenamed("recipe_id", "o_orderkey"), "o_orderkey", "left_semi").select("o_custkey").distinct()


def _active(spark, sf_dir) -> DataFrame:
    """Ontology nodes that are in use: suppliers with even keys, nations below 20, the first region."""
    nodes = ontology(spark, sf_dir).select(F.col("child").alias("node")).union(ontology(spark, sf_dir).select("parent")).distinct()
    number = F.substring("node", 2, 10).cast("int")
    return nodes.where((F.col("node").startswith("S") & (number % 2 == 0)) | (F.col("node").startswith("N") & (number < 20)) | (F.col("node") == "R0"))


def _cut(spark, sf_dir) -> DataFrame:
    """Lines with the ontology leaf of their source."""
    return recipe_lines(spark, sf_dir).withColumn("leaf", leaf("source_id"))


def se10_deepest_antichain(spark, sf_dir):
    return hierarchy.deepest_antichain(_active(spark, sf_dir), hierarchy.closure(ontology(spark, sf_dir)))


def se12_closure(spark, sf_dir):
    return hierarchy.closure(ontology(spark, sf_dir))


def se13_pareto_four(spark, sf_dir):
    """Suppliers of a nation that no other beats in balance, lines, grams and mean price at once.

    Rows with equal metrics are one point before they are compared."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("grams"), F.round(F.avg("l_extendedprice"), 2).alias("price"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal").join(per, "s_suppkey")
    metrics = ["s_acctbal", "n", "grams", "price"]
    points = rows.groupBy("s_nationkey", *metrics).agg(F.min("s_suppkey").alias("point"))
    front = rel.pareto_front(points, "s_nationkey", "point", metrics)
    return rows.join(front, ["s_nationkey", *metrics], "left_semi").select("s_nationkey", "s_suppkey")


def se15_siblings(spark, sf_dir):
    """Pairs of distinct food names with the same last word."""
    names = foods(spark, sf_dir).select("description").distinct().withColumn("stem", F.element_at(F.split("description", " "), -1))
    a, b = names.withColumnRenamed("description", "a"), names.withColumnRenamed("description", "b")
    return a.join(b, "stem").where("a < b").select("stem", "a", "b")


def j13_lines_to_ancestors(spark, sf_dir):
    paths = hierarchy.closure(ontology(spark, sf_dir))
    return _cut(spark, sf_dir).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(paths, F.col("leaf") == F.col("node")).groupBy("ancestor").agg(F.sum("n").alias("n"))


def j14_nearest_active(spark, sf_dir):
    paths = hierarchy.closure(ontology(spark, sf_dir))
    leaves = table(spark, sf_dir, "supplier").select(leaf("s_suppkey").alias("leaf"))
    return hierarchy.rollup(leaves, "leaf", paths, _active(spark, sf_dir))


def ag24_subtree_metrics(spark, sf_dir):
    out = hierarchy.subtree_totals(_cut(spark, sf_dir), "leaf", hierarchy.closure(ontology(spark, sf_dir)), "recipe_id", "grams")
    return out.select("ancestor", "n_lines", "n_recipes", F.round("grams", 4).alias("grams"))


def ag25_rollup_totals(spark, sf_dir):
    paths = hierarchy.closure(ontology(spark, sf_dir))
    leaves = _cut(spark, sf_dir).groupBy("leaf").agg(F.sum("grams").alias("grams"), F.count(F.lit(1)).alias("lines"), F.min("food_id").alias("first_food"))
    return leaves.join(paths, F.col("leaf") == F.col("node")).groupBy("ancestor").agg(
        F.sum("grams").alias("grams"), F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("leaves"), F.min("first_food").alias("first_food")
    )


def aj8_rollup_levels(spark, sf_dir):
    """Per recipe the sorted nodes at each level: leaf, nation, region."""
    paths = hierarchy.closure(ontology(spark, sf_dir))
    at = lambda d: F.array_join(F.array_sort(F.collect_set(F.when(F.col("depth") == d, F.col("ancestor")))), " ")
    leaves = _cut(spark, sf_dir).select("recipe_id", "leaf").distinct()
    return leaves.join(paths, F.col("leaf") == F.col("node")).groupBy("recipe_id").agg(at(0).alias("leaves"), at(1).alias("basis"), at(2).alias("coarse"))


def x1_coverage(spark, sf_dir):
    """Rates by status and kind; a null kind is a group of its own."""
    lines = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).where("size <= 40").select("food_id", "brand"), "food_id", "left")
    return lines.groupBy("status", "brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("grams") > 25).cast("double")), 6).alias("rate"), F.round(F.avg("grams"), 4).alias("mean_grams"))


def x2_audit_sample(spark, sf_dir):
    """Thirty lines: the first eight of each status, then by key up to thirty; a sampling operator."""
    lines = recipe_lines(spark, sf_dir).select("recipe_id", "line", "food_id", "source_id", "status")
    order = ["recipe_id", "line", "food_id", "source_id"]
    head = rel.top_k(lines, ["status"], [F.asc(c) for c in order], 8).drop("rank")
    rest = lines.join(head, order, "left_anti").orderBy(*order).limit(30)
    both = head.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))
    return both.orderBy("tier", *order).limit(30).select(*order)


def x4_error_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bucket = F.when(F.col("event_type") != "error", "fine").when(F.col("value") > 300, "severe").when(F.col("value") > 100, "some").otherwise("slight")
    return e.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def x6_labels_and_more(spark, sf_dir):
    """The first three distinct food names of a recipe and how many more there are."""
    sets = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).select("food_id", "description"), "food_id").groupBy("recipe_id").agg(F.array_sort(F.collect_set("description")).alias("all"))
    more = F.when(F.size("all") > 3, F.concat(F.lit(", +"), (F.size("all") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return sets.select("recipe_id", F.concat(F.array_join(F.slice("all", 1, 3), ", "), more).alias("labels"))


def x11_missing_nodes(spark, sf_dir):
    """Per recipe the three most used brands that it lacks: of the brands by use, the first (brands that the
    recipe has) + 3 hold them, so no recipe meets all brands.  A recipe's brands are one short array."""
    lines = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).select("food_id", "brand"), "food_id")
    held = stored(lines.groupBy("recipe_id").agg(F.collect_set(F.struct("brand")).alias("held")))
    popular = held.select(F.inline("held")).groupBy("brand").agg(F.count(F.lit(1)).alias("hits"))
    most = held.agg(F.max(F.size("held"))).first()[0] or 0
    first = popular.orderBy(F.desc("hits"), "brand").limit(most + 3)  # as many rows as the largest recipe has, and 3
    first = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("less"), "brand"))).alias("first"))
    recipes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id")).join(held.hint("merge"), "recipe_id", "left").crossJoin(F.broadcast(first))
    # merged, as compressed arrays look small enough for a broadcast and are not
    has = F.when(F.col("held").isNull(), 0).otherwise(F.size("held"))
    lacks = lambda x: ~F.coalesce(F.array_contains("held.brand", x["brand"]), F.lit(False))
    three = F.slice(F.filter(F.slice("first", 1, has + 3), lacks), 1, 3)
    return recipes.select("recipe_id", F.inline(three)).select("recipe_id", "brand", (-F.col("less")).alias("hits"))


def x19_step_deltas(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(order), 4).alias("delta"))


def x20_clear_favourite(spark, sf_dir):
    """A customer's dearest order, less a handicap for urgent ones, must lead by 50,000."""
    score = F.col("o_totalprice") - F.when(F.col("o_orderpriority") == "1-URGENT", 20000).otherwise(0)
    ranked = rel.with_margin(table(spark, sf_dir, "orders").withColumn("score", score), ["o_custkey"], [F.desc("score"), F.asc("o_orderkey")], "score")
    return ranked.where("rank = 1").select("o_custkey", "o_orderkey", (F.col("margin") >= 50000).alias("clear"))


def x21_rescaled(spark, sf_dir):
    """Grams scaled to 100 a recipe where its sum is within 20 % of that, else unchanged."""
    total = F.sum("grams").over(Window.partitionBy("recipe_id"))
    scaled = F.when(F.abs(total / 100 - 1) <= 0.2, F.col("grams") * 100 / total).otherwise(F.col("grams"))
    return recipe_lines(spark, sf_dir).select("recipe_id", "line", "food_id", "source_id", F.round(scaled, 4).alias("grams"))


def x28_next_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("version"))


_PATHS = """
WITH RECURSIVE e AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
p AS (SELECT child AS node, child AS ancestor, 0 AS depth FROM e UNION SELECT parent, parent, 0 FROM e UNION SELECT p.node, e.parent, p.depth + 1 FROM p JOIN e ON e.child = p.ancestor),
paths AS (SELECT node, ancestor, min(depth)::INT AS depth FROM p GROUP BY 1, 2),
active AS (SELECT DISTINCT node FROM paths WHERE (node[1] = 'S' AND node[2:]::INT % 2 = 0) OR (node[1] = 'N' AND node[2:]::INT < 20) OR node = 'R0')"""
_LINKS = """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 380000),
l AS (SELECT DISTINCT a, o_custkey AS b FROM o JOIN (SELECT day, min(o_custkey) AS a FROM o GROUP BY 1) USING (day) WHERE a <> o_custkey),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS m FROM g UNION SELECT g.b, r.m FROM r JOIN g ON g.a = r.node),
c AS (SELECT node, min(m) AS component FROM r GROUP BY 1)"""
_DRAW = "(('0x' || md5({})[1:13])::BIGINT / 4503599627370496.0)"

SQL = {
    "w1_named_first": r"""
SELECT food_id, description FROM (SELECT p_partkey AS food_id, p_name AS description, row_number() OVER (PARTITION BY lower(p_name) ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_size DESC NULLS LAST, p_partkey DESC) AS r FROM part) WHERE r = 1""",
    "w4_line_index": """
SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS idx FROM lineitem""",
    "w6_lead_difference": "SELECT o_orderkey, round(o_totalprice - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 4) AS margin FROM orders",
    "w8_rank_by_many_keys": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "w9_later_copies": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS n FROM documents) WHERE n > 1",
    "w10_latest_check": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "w12_pool_leaders": "SELECT c_mktsegment, c_custkey AS leader FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - 5000), c_custkey) AS r FROM customer) WHERE r = 1",
    "t3_top_or_above": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3 OR o_totalprice >= 300000",
    "t4_mixed_sort": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 100",
    "t5_largest": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    "t6_seeded_sample": f"SELECT o_orderkey FROM orders ORDER BY {_DRAW.format(chr(39) + '17:' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 200",
    "t7_weighted_sample": f"""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT c_mktsegment, c_custkey, -ln({_DRAW.format("'5:' || c_custkey")} + 1e-12) / sqrt(n) AS key FROM customer JOIN n ON o_custkey = c_custkey)
SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY key, c_custkey) AS r FROM k) WHERE r <= 5""",
    "t10_three_tiers": """
WITH f AS (SELECT p_partkey AS food_id, p_brand AS brand, p_size AS size, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n, food_id) AS ra FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY brand, ra > 3 ORDER BY size DESC, food_id) AS rb FROM a),
t AS (SELECT food_id, brand, CASE WHEN ra <= 3 THEN 'rare' WHEN rb <= 5 THEN 'large' END AS tier FROM b), h AS (SELECT brand, count(tier) AS have FROM t GROUP BY 1),
r AS (SELECT food_id, brand, row_number() OVER (PARTITION BY brand ORDER BY food_id) AS r FROM t WHERE tier IS NULL)
SELECT food_id, brand, tier FROM t WHERE tier IS NOT NULL UNION ALL SELECT food_id, brand, 'top-up' FROM r JOIN h USING (brand) WHERE r <= 10 - have""",
    "t12_viable_swap": """
WITH r AS (SELECT l_suppkey AS source_id, l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_returnflag = 'A' AS viable, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS place,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag = 'A' ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS among FROM lineitem),
c AS (SELECT source_id, greatest(count(*) FILTER (viable AND place <= 10), least(7, count(*) FILTER (viable))) AS wanted FROM r GROUP BY 1)
SELECT source_id, recipe_id, line, food_id, viable FROM r JOIN c USING (source_id) WHERE among <= CASE WHEN viable THEN wanted ELSE 10 - wanted END""",
    "t13_best_band_median": """
WITH b AS (SELECT c_mktsegment, low, count(*) AS n FROM customer, (SELECT unnest(range(-1000, 9001, 500))::INT AS low) WHERE c_acctbal BETWEEN low AND low + 1000 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY low) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY c_mktsegment) AS most FROM b) WHERE n = most)
SELECT c_mktsegment, low, n FROM t WHERE r = (ties + 1) // 2""",
    "se1_union_of_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "supplier", "part", "orders", "lineitem")),
    "se2_core_and_shell": """
SELECT l_orderkey AS recipe_id, l_partkey AS food_id, l_quantity AS grams, CASE WHEN l_suppkey = 3 THEN 1.0::DOUBLE ELSE 0.5 END AS weight FROM lineitem WHERE l_suppkey IN (3, 5)""",
    "se3_id_sets": """
WITH a AS (SELECT DISTINCT l_partkey AS food_id FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS food_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT food_id, CASE WHEN food_id IN (SELECT food_id FROM r) THEN 'both' ELSE 'only' END AS part FROM a""",
    "se6_components": _LINKS + " SELECT node, component FROM c",
    "se7_keepers": _LINKS + """,
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY n DESC, c_acctbal DESC, node) AS r, count(*) OVER (PARTITION BY component) AS size
  FROM c JOIN n ON o_custkey = node JOIN customer ON c_custkey = node) SELECT component, node AS keeper, size FROM k WHERE r = 1""",
    "se8_signature_dedup": """
WITH s AS (SELECT p_partkey, p_retailprice, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS s FROM part)
SELECT p_partkey AS food_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_retailprice, p_partkey) AS r FROM s) WHERE r = 1 OR p_partkey IN (7, 77, 177)""",
    "se9_recipes_in_use": "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45",
    "se10_deepest_antichain": _PATHS + " SELECT node FROM active WHERE node NOT IN (SELECT ancestor FROM paths JOIN active USING (node) WHERE depth > 0)",
    "se12_closure": _PATHS + " SELECT node, ancestor, depth FROM paths",
    "se13_pareto_four": """
WITH m AS (SELECT s_nationkey, s_suppkey, s_acctbal AS w, n, g, p FROM supplier JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS g, round(avg(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)
SELECT s_nationkey, s_suppkey FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.s_nationkey = b.s_nationkey AND b.w <= a.w AND b.n <= a.n AND b.g <= a.g AND b.p <= a.p AND (b.w < a.w OR b.n < a.n OR b.g < a.g OR b.p < a.p))""",
    "se15_siblings": """
WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[-1] AS stem FROM part) SELECT a.stem, a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.stem = b.stem AND a.p_name < b.p_name""",
    "j13_lines_to_ancestors": _PATHS + " SELECT ancestor, count(*) AS n FROM lineitem JOIN paths ON node = 'S' || l_suppkey GROUP BY 1",
    "j14_nearest_active": _PATHS + """
SELECT 'S' || s_suppkey AS leaf, (SELECT arg_min(paths.ancestor, [lpad(depth::VARCHAR, 3, '0'), paths.ancestor]) FROM paths JOIN active ON active.node = paths.ancestor WHERE paths.node = 'S' || s_suppkey) AS rolled FROM supplier""",
    "ag24_subtree_metrics": _PATHS + " SELECT ancestor, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_recipes, round(sum(l_quantity), 4) AS grams FROM lineitem JOIN paths ON node = 'S' || l_suppkey GROUP BY 1",
    "ag25_rollup_totals": _PATHS + " SELECT ancestor, sum(l_quantity) AS grams, count(*) AS lines, count(DISTINCT node) AS leaves, min(l_partkey) AS first_food FROM lineitem JOIN paths ON node = 'S' || l_suppkey GROUP BY 1",
    "aj8_rollup_levels": _PATHS + """
SELECT l_orderkey AS recipe_id, coalesce(string_agg(DISTINCT ancestor, ' ' ORDER BY ancestor) FILTER (depth = 0), '') AS leaves, coalesce(string_agg(DISTINCT ancestor, ' ' ORDER BY ancestor) FILTER (depth = 1), '') AS basis,
  coalesce(string_agg(DISTINCT ancestor, ' ' ORDER BY ancestor) FILTER (depth = 2), '') AS coarse FROM lineitem JOIN paths ON node = 'S' || l_suppkey GROUP BY 1""",
    "x1_coverage": """
SELECT l_returnflag AS status, p_brand AS brand, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS rate, round(avg(l_quantity), 4) AS mean_grams FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 GROUP BY 1, 2""",
    "x2_audit_sample": """
WITH r AS (SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT recipe_id, line, food_id, source_id FROM r ORDER BY n > 8, recipe_id, line, food_id, source_id LIMIT 30""",
    "x4_error_buckets": "SELECT CASE WHEN event_type <> 'error' THEN 'fine' WHEN value > 300 THEN 'severe' WHEN value > 100 THEN 'some' ELSE 'slight' END AS bucket, count(*) AS n FROM events GROUP BY 1",
    "x6_labels_and_more": """
WITH s AS (SELECT l_orderkey AS recipe_id, list_sort(list(DISTINCT p_name)) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT recipe_id, array_to_string(s[1:3], ', ') || CASE WHEN len(s) > 3 THEN ', +' || (len(s) - 3) || ' more' ELSE '' END AS labels FROM s""",
    "x11_missing_nodes": """
WITH h AS (SELECT DISTINCT l_orderkey AS r, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey), p AS (SELECT brand, count(*) AS hits FROM h GROUP BY 1),
x AS (SELECT o_orderkey AS recipe_id, p.* FROM orders, p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.r = o_orderkey AND h.brand = p.brand))
SELECT recipe_id, brand, hits FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY hits DESC, brand) AS n FROM x) WHERE n <= 3""",
    "x19_step_deltas": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS delta FROM events",
    "x20_clear_favourite": """
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice - CASE WHEN o_orderpriority = '1-URGENT' THEN 20000 ELSE 0 END AS s FROM orders),
r AS (SELECT *, row_number() OVER w AS r, s - coalesce(lead(s) OVER w, 0) AS margin FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey)) SELECT o_custkey, o_orderkey, margin >= 50000 AS clear FROM r WHERE r = 1""",
    "x21_rescaled": """
WITH t AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)
SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, round(CASE WHEN abs(t / 100 - 1) <= 0.2 THEN l_quantity * 100 / t ELSE l_quantity END, 4) AS grams FROM t""",
    "x28_next_version": "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS version FROM orders GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
