"""Neighbourhoods of recipes: every customer is a problem whose core recipes are its own orders; leaves are
foods, cut nodes are brands, and the recipes whose id has an embedding have a vector."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import neighborhood, set_join, vectors
from millrace.operators.lineage import stored
from millrace.plans.tables import foods, recipe_lines, table

DIMENSIONS = 64
#: Core items of a problem: its most frequent brands.
CORE_ITEMS = 2


def _brands(spark, sf_dir):
    """(brand, code): brands numbered in their order, as arrays of numbers are narrower than those of names."""
    brands = foods(spark, sf_dir).where("brand is not null").select("brand").distinct()
    return stored(brands.withColumn("code", F.row_number().over(Window.orderBy("brand"))), "brands")


def _inputs(spark, sf_dir, names):
    core = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("recipe_id"))
    brands = foods(spark, sf_dir).join(names, "brand").select(F.col("food_id").alias("item"), F.col("code").alias("label"))
    recipes = set_join.rarest_first_sets(recipe_lines(spark, sf_dir).select("recipe_id", "food_id"), "recipe_id", "food_id", brands)
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recipe_id"), F.col("embedding").alias("vector"))
    return neighborhood.prepared(core, recipes.withColumnRenamed("labels", "nodes"), vectors_, DIMENSIONS), vectors_


def v10_neighborhood_shell(spark, sf_dir):
    """The shell of every customer's recipes."""
    return neighborhood.shell(*_inputs(spark, sf_dir, _brands(spark, sf_dir))).drop("nodes")


def v10_nearest_core(spark, sf_dir):
    """Pairs of recipes whose foods are alike by 0.35 or more, through the filters of the set join."""
    leaves = recipe_lines(spark, sf_dir).select("recipe_id", F.col("food_id").alias("leaf"))
    sets = stored(set_join.rarest_first_sets(leaves, "recipe_id", "leaf"), "sets")
    made, members = set_join.classes_of(sets, "recipe_id")
    pairs = set_join.similar_classes(made.select("class", "items", F.lit(neighborhood.FLOOR).alias("floor")))
    ends = lambda x, y: F.struct(F.col(x).alias("class"), F.col(y).alias("other"))
    best = pairs.select("jaccard", F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e")).select("e.*", "jaccard")
    best = best.groupBy("class").agg(F.max_by("other", F.struct(F.round("jaccard", 8), -F.col("other"))).alias("other"), F.round(F.max("jaccard"), 8).alias("jaccard"))
    return members.join(best, "class").select("recipe_id", F.col("other").alias("nearest"), "jaccard")


def v12_cooccurrence(spark, sf_dir):
    """Shares of other brands among a customer's recipes and their shell that hold its two most frequent brands."""
    names = _brands(spark, sf_dir)
    problems, recipe_vectors = _inputs(spark, sf_dir, names)
    shell = neighborhood.shell(problems, recipe_vectors)
    neighbors = problems.held.select("problem", F.col("nodes").alias("items")).unionByName(shell.select("problem", F.col("nodes").alias("items")))
    often = F.transform(F.slice("nodes", 1, CORE_ITEMS), lambda x: x["node"])
    shares = neighborhood.cooccurrence(neighbors, problems.profiles.select("problem", often.alias("core_items")))
    return shares.join(names, F.col("item") == F.col("code")).select("problem", F.col("brand").alias("item"), "share")


def j9_query_catalog_pairs(spark, sf_dir):
    """All vectors at a cosine of 0.3 or more from the mean vector of each label: queries against a catalog."""
    rows = table(spark, sf_dir, "embeddings")
    queries = vectors.centroids(rows.where("label is not null"), "label", "embedding", DIMENSIONS)
    found = vectors.within(queries, rows, 0.3, ("label", "centroid"), ("vec_id", "embedding"))
    return found.select("label", "vec_id", F.round("similarity", 5).alias("similarity"))


_SETS = """core AS (SELECT o_custkey AS problem, o_orderkey AS recipe_id FROM orders),
leaves AS (SELECT DISTINCT l_orderkey AS recipe_id, l_partkey AS leaf FROM lineitem),
brands AS (SELECT DISTINCT l_orderkey AS recipe_id, p_brand AS node FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT recipe_id, count(*) AS n FROM leaves GROUP BY 1),
pairs AS (SELECT a.recipe_id AS a, b.recipe_id AS b, count(*) AS shared FROM leaves a JOIN leaves b ON a.leaf = b.leaf AND a.recipe_id <> b.recipe_id GROUP BY 1, 2),
alike AS (SELECT a, b, shared / (x.n + y.n - shared) AS jaccard FROM pairs JOIN n x ON x.recipe_id = a JOIN n y ON y.recipe_id = b)"""
_SHELL = _SETS + """,
sizes AS (SELECT problem, count(*) AS n_core FROM core GROUP BY 1 HAVING count(*) < 40),
thin AS (SELECT * FROM core JOIN sizes USING (problem)),
e AS (SELECT vec_id AS recipe_id, embedding::DOUBLE[] AS v FROM embeddings),
sums AS (SELECT problem, i, avg(v[i + 1]) AS x FROM thin JOIN e USING (recipe_id), range(64) r(i) GROUP BY 1, 2),
means AS (SELECT problem, list(x ORDER BY i) AS m FROM sums GROUP BY 1),
leaf_met AS (SELECT problem, a AS recipe_id, max(jaccard) AS foodon FROM alike JOIN thin t ON t.recipe_id = b GROUP BY 1, 2),
vector_met AS (SELECT problem, recipe_id, 0.0 AS foodon FROM means, e WHERE recipe_id IN (SELECT recipe_id FROM n) AND list_dot_product(m, v) / sqrt(list_dot_product(m, m) * list_dot_product(v, v)) >= 0.875 - 1e-6),
met AS (SELECT problem, recipe_id, max(foodon)::DOUBLE AS foodon FROM (SELECT * FROM leaf_met UNION ALL SELECT * FROM vector_met) u ANTI JOIN thin USING (problem, recipe_id) GROUP BY 1, 2),
counted AS (SELECT problem, node, count(*) >= greatest(2, ceil(0.25 * any_value(n_core))) AS often FROM thin JOIN brands USING (recipe_id) GROUP BY 1, 2),
anchors AS (SELECT problem, node, count(*) OVER (PARTITION BY problem) AS n_anchors FROM (SELECT *, max(often::INT) OVER (PARTITION BY problem) AS any_often FROM counted) WHERE often OR any_often = 0),
near AS (SELECT problem, recipe_id FROM met JOIN brands USING (recipe_id) JOIN anchors USING (problem, node) GROUP BY 1, 2 HAVING count(*) >= least(2, any_value(n_anchors))),
blended AS (SELECT problem, recipe_id, foodon, m, CASE WHEN m IS NULL OR v IS NULL THEN 0.0 ELSE least(greatest(list_dot_product(m, v) / sqrt(list_dot_product(m, m) * list_dot_product(v, v)), 0.0), 1.0) END::DOUBLE AS semantic
  FROM met SEMI JOIN near USING (problem, recipe_id) LEFT JOIN means USING (problem) LEFT JOIN e USING (recipe_id)),
scored AS (SELECT problem, recipe_id, round(foodon, 8) AS foodon, round(semantic, 8) AS semantic, round(CASE WHEN m IS NULL THEN foodon ELSE 0.6 * foodon + 0.4 * semantic END, 8)::DOUBLE AS similarity FROM blended),
shell AS (SELECT problem, recipe_id, foodon, semantic, similarity, round(greatest(0.05, least(0.5, 0.5 * similarity / 0.35)), 8)::DOUBLE AS weight,
  row_number() OVER (PARTITION BY problem ORDER BY similarity DESC, recipe_id)::INT AS rank, n_core FROM scored JOIN sizes USING (problem) WHERE similarity >= 0.35)"""
SQL = {
    "v10_neighborhood_shell": f"WITH {_SHELL} SELECT problem, recipe_id, foodon, semantic, similarity, weight, rank FROM shell WHERE rank <= least(60, 40 - n_core)",
    "v10_nearest_core": f"WITH {_SETS}, r AS (SELECT a, b, round(jaccard, 8)::DOUBLE AS jaccard FROM alike WHERE jaccard >= 0.35 - 1e-9), "
    "same AS (SELECT recipe_id, min(recipe_id) OVER (PARTITION BY items) AS class FROM (SELECT recipe_id, list(leaf ORDER BY leaf) AS items FROM leaves GROUP BY 1)) "
    "SELECT a AS recipe_id, b AS nearest, jaccard FROM r JOIN same x ON x.recipe_id = a JOIN same y ON y.recipe_id = b WHERE x.class <> y.class AND b = y.class "
    "QUALIFY row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) = 1",
    "v12_cooccurrence": f"""WITH {_SHELL}, neighbors AS (SELECT problem, recipe_id FROM core UNION ALL SELECT problem, recipe_id FROM shell WHERE rank <= least(60, 40 - n_core)),
often AS (SELECT problem, node, count(*) AS n FROM core JOIN brands USING (recipe_id) GROUP BY 1, 2),
wanted AS (SELECT problem, node FROM often QUALIFY row_number() OVER (PARTITION BY problem ORDER BY n DESC, node) <= 2),
w AS (SELECT problem, count(*) AS wanted FROM wanted GROUP BY 1),
held AS (SELECT problem, recipe_id, count(*) AS held FROM neighbors JOIN brands USING (recipe_id) JOIN wanted USING (problem, node) GROUP BY 1, 2),
whole AS (SELECT problem, recipe_id, coalesce(held = wanted, false) AS whole FROM neighbors JOIN w USING (problem) LEFT JOIN held USING (problem, recipe_id)),
used AS (SELECT *, count(*) OVER (PARTITION BY problem) AS n FROM (SELECT *, max(whole::INT) OVER (PARTITION BY problem) AS any_often FROM whole) WHERE whole OR any_often = 0)
SELECT problem, node AS item, round(count(*) / any_value(n), 8)::DOUBLE AS share FROM used JOIN brands USING (recipe_id) ANTI JOIN wanted USING (problem, node) GROUP BY 1, 2""",
    "j9_query_catalog_pairs": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, i, avg(v[i + 1]) AS x FROM e, range(64) r(i) WHERE label IS NOT NULL GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY 1), p AS (SELECT c.label, vec_id, list_dot_product(m, v) / sqrt(list_dot_product(m, m) * list_dot_product(v, v)) AS s FROM c, e)
SELECT label::BIGINT AS label, vec_id, round(s, 5) AS similarity FROM p WHERE round(s, 8) >= 0.3""",
}
QUERIES = {name: globals()[name] for name in SQL}
