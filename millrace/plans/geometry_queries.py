"""Hulls of nutrient shares, loss fields over them, clusters and diverse choices of vectors.

A food's grams of protein, fat and carbohydrate come from its size, key and price; a box of shares is asked
of every recipe, and every customer has a box of its own on the lattice of the loss field.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import clusters, hulls, loss_fields
from millrace.operators.lineage import checkpointed
from millrace.plans.tables import foods, recipe_lines, table

#: The box that recipes are held against: least and greatest share of protein, carbohydrate and fat.
LOW, HIGH = (0.30, 0.25, 0.20), (0.40, 0.35, 0.45)
STEPS = 64
CLUSTERS, PICKS = 16, 40


def _shares(spark, sf_dir):
    """food_id, x, y: shares of protein and carbohydrate in units of the grid."""
    f = foods(spark, sf_dir)
    x, y = hulls.share_points(F.col("size"), F.col("food_id") % 17 + 1, F.floor("amount").cast("long") % 29 + 1)
    return f.select("food_id", x.alias("x"), y.alias("y"))


def _recipe_hulls(spark, sf_dir):
    return hulls.hulls(recipe_lines(spark, sf_dir).select("recipe_id", "food_id").join(_shares(spark, sf_dir), "food_id"), "recipe_id")


def v19_recipe_hulls(spark, sf_dir):
    """Every recipe's hull against the box."""
    found = hulls.against_box(_recipe_hulls(spark, sf_dir), "recipe_id", LOW, HIGH)
    return found.withColumn("share_inside", F.round("share_inside", 6))


def v19_source_hulls(spark, sf_dir):
    """The hull of each status over all lines, three groups that hold a third of the rows each, vertex by vertex."""
    kind = F.when(F.col("status") == "A", 0).when(F.col("status") == "N", 1).otherwise(2)
    points = recipe_lines(spark, sf_dir).select(kind.alias("kind"), "food_id").join(_shares(spark, sf_dir), "food_id")
    made = hulls.hulls(points, "kind")
    return made.select("kind", F.explode(F.arrays_zip("xs", "ys")).alias("v")).select("kind", F.col("v.xs").alias("x"), F.col("v.ys").alias("y"))


def x18_hull_context(spark, sf_dir):
    """Per customer how its recipes' hulls meet the box: hits, share, outside scores and the level."""
    rows = v19_recipe_hulls(spark, sf_dir)
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.col("o_custkey").alias("problem"))
    # equal scores are counted before they meet, so a group is as long as its distinct scores
    counted = rows.join(owner, "recipe_id").groupBy("problem", "outside_score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share_inside") > 0).alias("hits"))
    at = lambda q: F.round(F.percentile("outside_score", q, F.col("n")), 8)
    share, micro = F.sum("hits") / F.sum("n"), F.round(F.col("outside_score") * 1e6).cast("long")
    out = counted.groupBy("problem").agg(
        F.sum("n").alias("n_recipes"), F.sum("hits").alias("n_hits"), F.round(share, 6).alias("share"), at(0.5).alias("median_outside"),
        (F.sum(micro * F.col("n")) / F.sum("n") / 1e6).alias("mean_outside"), at(0.75).alias("p75_outside"),
        F.min("outside_score").alias("min_outside"), F.max("outside_score").alias("max_outside"),
    )
    return out.withColumn("level", hulls.stretch_level(F.col("n_hits") / F.col("n_recipes"), F.col("median_outside")))


def v21_targets(spark, sf_dir):
    """Seeded targets of every recipe, close to its foods, on the edge of their hull and outside."""
    weighed = recipe_lines(spark, sf_dir).select("recipe_id", "food_id", "grams").join(_shares(spark, sf_dir), "food_id")
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("grams")) / F.sum("grams")).cast("long")
    baselines = weighed.where("grams > 0").groupBy("recipe_id").agg(mean("x").alias("bx"), mean("y").alias("by"))
    return hulls.targets(_recipe_hulls(spark, sf_dir), baselines, "recipe_id", seed=17)


def _lattice(spark, sf_dir):
    step = lambda c: F.round(F.col(c) * STEPS / hulls.GRID).cast("int")
    points = recipe_lines(spark, sf_dir).select("food_id", F.col("grams").alias("weight")).join(_shares(spark, sf_dir), "food_id").select(step("x").alias("p"), step("y").alias("c"), "weight")
    return checkpointed(loss_fields.lattice_loss(points, STEPS))


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    low = {"p": k % 20, "c": (7 * k) % 30, "f": (3 * k) % 16}
    width = {"p": 4 + k % 9, "c": F.lit(8), "f": 8 + k % 25}
    return table(spark, sf_dir, "customer").select(k.alias("box_id"), *[(low[m] + extra).cast("int").alias(f"{m}_{end}") for m in "pcf" for end, extra in (("low", F.lit(0)), ("high", width[m]))])


def v20_loss_lattice(spark, sf_dir):
    return _lattice(spark, sf_dir)


def v20_box_minima(spark, sf_dir):
    """The least loss inside every customer's box."""
    return loss_fields.box_minima(_boxes(spark, sf_dir), loss_fields.block_minima(_lattice(spark, sf_dir), STEPS), STEPS)


def v20_corridor(spark, sf_dir):
    """The point of the low-loss basin that is nearest to every customer's box."""
    return loss_fields.corridor(_boxes(spark, sf_dir), loss_fields.basin(_lattice(spark, sf_dir)), STEPS)


def v20_basin(spark, sf_dir):
    return loss_fields.basin(_lattice(spark, sf_dir))


def _units(spark, sf_dir):
    return checkpointed(clusters.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def v4_spherical_kmeans(spark, sf_dir):
    """The cluster of every vector at the fixed point of spherical k-means."""
    rows = _units(spark, sf_dir)
    centroids = clusters.spherical_kmeans(rows, clusters.seeds(rows, CLUSTERS, seed=42))
    return clusters.assign(rows, centroids).select(F.col("key").alias("vec_id"), "cluster", F.round("similarity", 6).alias("similarity"))


def t9_farthest_points(spark, sf_dir):
    """Forty vectors, each the farthest from those before; a top-k selection."""
    found = clusters.diverse(_units(spark, sf_dir), PICKS)
    return found.select("pick", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def t8_diverse_relevant(spark, sf_dir):
    """Forty vectors that balance the number of lines of the food of the same id against likeness."""
    lines = recipe_lines(spark, sf_dir).groupBy(F.col("food_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    found = clusters.diverse(_units(spark, sf_dir), PICKS, weight=0.3, relevance=lines.select("key", (F.col("n") / (F.col("n") + 30)).alias("relevance")))
    return found.select("pick", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def p4_diverse_sample(spark, sf_dir):
    """Clusters, their medoids, and of these ten: the three of the smallest clusters, then the most diverse."""
    rows = _units(spark, sf_dir)
    centroids = clusters.spherical_kmeans(rows, clusters.seeds(rows, CLUSTERS, seed=42))
    middle = checkpointed(clusters.medoids(rows, centroids))
    rare = middle.orderBy("size", "key").limit(3).select("key", F.lit("rare").alias("tier"))
    rest = rows.join(middle, "key", "left_semi").join(rare, "key", "left_anti")
    filled = clusters.diverse(rest, 7).select("key", F.lit("diverse").alias("tier"))
    return rare.unionByName(filled).join(middle, "key").select(F.col("key").alias("vec_id"), "tier", "cluster", "size")


_SHARES = """f AS (SELECT p_partkey AS food_id, p_size * 4.0::DOUBLE AS p, (p_partkey % 17 + 1) * 9.0::DOUBLE AS f, (floor(p_retailprice)::BIGINT % 29 + 1) * 4.0::DOUBLE AS c FROM part),
s AS (SELECT food_id, round(p / (p + f + c) * 100000000)::BIGINT AS x, round(c / (p + f + c) * 100000000)::BIGINT AS y FROM f)"""
_AT = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(hulls.box_points(LOW, HIGH)))
_TURN = lambda a, b, p: f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"
_IN = f"""(({_TURN('a', 'b', 'q')} >= 0 AND {_TURN('b', 'c', 'q')} >= 0 AND {_TURN('c', 'a', 'q')} >= 0) OR ({_TURN('a', 'b', 'q')} <= 0 AND {_TURN('b', 'c', 'q')} <= 0 AND {_TURN('c', 'a', 'q')} <= 0))"""
#: Inside is inside a triangle of three points; elsewhere the nearest segment between two points counts.
_HULLS = f"""{_SHARES},
pts AS MATERIALIZED (SELECT DISTINCT l_orderkey AS recipe_id, x, y FROM lineitem JOIN s ON food_id = l_partkey),
tri AS MATERIALIZED (SELECT a.recipe_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM pts a JOIN pts b ON a.recipe_id = b.recipe_id AND (a.x, a.y) < (b.x, b.y)
  JOIN pts c ON c.recipe_id = a.recipe_id AND (b.x, b.y) < (c.x, c.y) WHERE {_TURN('a', 'b', 'c')} <> 0),
t AS MATERIALIZED (SELECT recipe_id, struct_pack(x := x1, y := y1) AS a, struct_pack(x := x2, y := y2) AS b, struct_pack(x := x3, y := y3) AS c FROM tri),
q AS (SELECT * FROM (VALUES {_AT}) v(qid, x, y)),
hit AS (SELECT DISTINCT recipe_id, qid FROM t, q WHERE {_IN}),
seg AS (SELECT a.recipe_id, q.qid, q.x - a.x AS rx, q.y - a.y AS ry, (b.x - a.x)::DOUBLE AS dx, (b.y - a.y)::DOUBLE AS dy FROM pts a JOIN pts b ON a.recipe_id = b.recipe_id AND (a.x, a.y) <= (b.x, b.y), q),
clip AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((rx * dx + ry * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS w FROM seg),
far AS (SELECT recipe_id, qid, min(sqrt((rx - w * dx) ** 2 + (ry - w * dy) ** 2)) / 100000000 AS d FROM clip GROUP BY ALL),
dist AS (SELECT recipe_id, qid, CASE WHEN hit.qid IS NULL THEN d ELSE 0 END AS d FROM far LEFT JOIN hit USING (recipe_id, qid)),
corner AS (SELECT p.recipe_id, count(*) AS n_vertices FROM pts p WHERE NOT EXISTS (SELECT 1 FROM t JOIN (SELECT p.x AS x, p.y AS y) q ON true WHERE t.recipe_id = p.recipe_id AND {_IN}
    AND (t.a.x, t.a.y) <> (p.x, p.y) AND (t.b.x, t.b.y) <> (p.x, p.y) AND (t.c.x, t.c.y) <> (p.x, p.y))
  AND NOT EXISTS (SELECT 1 FROM pts a JOIN pts b ON a.recipe_id = b.recipe_id AND (a.x, a.y) < (b.x, b.y) WHERE a.recipe_id = p.recipe_id AND (a.x, a.y) < (p.x, p.y) AND (p.x, p.y) < (b.x, b.y) AND {_TURN('a', 'b', 'p')} = 0) GROUP BY 1),
axes AS (SELECT recipe_id, min(x) / 1e8 AS p0, max(x) / 1e8 AS p1, min(y) / 1e8 AS c0, max(y) / 1e8 AS c1, (100000000 - max(x + y)) / 1e8 AS f0, (100000000 - min(x + y)) / 1e8 AS f1 FROM pts GROUP BY 1),
box AS (SELECT recipe_id, n_vertices, round(min(d), 6)::DOUBLE AS distance, round(avg((d <= 1e-4)::INT), 6)::DOUBLE AS share_inside,
  round(greatest(any_value(p0) - {HIGH[0]}, {LOW[0]} - any_value(p1), any_value(c0) - {HIGH[1]}, {LOW[1]} - any_value(c1), any_value(f0) - {HIGH[2]}, {LOW[2]} - any_value(f1), 0) + min(d), 6)::DOUBLE AS outside_score
  FROM dist JOIN corner USING (recipe_id) JOIN axes USING (recipe_id) GROUP BY ALL)"""
_FIELD = f"""{_SHARES}, bins AS (SELECT round(x * {STEPS} / 1e8)::INT AS p, round(y * {STEPS} / 1e8)::INT AS c, sum(l_quantity) AS w FROM lineitem JOIN s ON food_id = l_partkey WHERE l_quantity > 0 GROUP BY 1, 2),
lattice AS MATERIALIZED (SELECT i::INT AS i, j::INT AS j, round(sum(w * (abs(i - p) + abs(j - c) + abs(i + j - p - c))) / (sum(w) * {STEPS}), 8)::DOUBLE AS loss FROM range({STEPS + 1}) r(i), range({STEPS + 1}) t(j), bins WHERE i + j <= {STEPS} GROUP BY 1, 2),
boxes AS (SELECT c_custkey AS box_id, c_custkey % 20 AS p_low, c_custkey % 20 + 4 + c_custkey % 9 AS p_high, (7 * c_custkey) % 30 AS c_low, (7 * c_custkey) % 30 + 8 AS c_high, (3 * c_custkey) % 16 AS f_low, (3 * c_custkey) % 16 + 8 + c_custkey % 25 AS f_high FROM customer),
basin AS (SELECT *, (SELECT round(quantile_cont(loss, 0.25), 8) FROM lattice)::DOUBLE AS threshold FROM lattice WHERE loss <= (SELECT round(quantile_cont(loss, 0.25), 8) FROM lattice))"""
SQL = {
    "v19_recipe_hulls": f"WITH {_HULLS} SELECT * FROM box",
    "x18_hull_context": f"""WITH {_HULLS}, g AS (SELECT o_custkey AS problem, count(*) AS n_recipes, count(*) FILTER (WHERE share_inside > 0) AS n_hits, round(quantile_cont(outside_score, 0.5), 8)::DOUBLE AS median_outside,
  sum(round(outside_score * 1e6)::BIGINT) / count(*) / 1e6::DOUBLE AS mean_outside, round(quantile_cont(outside_score, 0.75), 8)::DOUBLE AS p75_outside, min(outside_score) AS min_outside, max(outside_score) AS max_outside FROM box JOIN orders ON o_orderkey = recipe_id GROUP BY 1)
SELECT *, round(n_hits / n_recipes, 6)::DOUBLE AS share, CASE WHEN n_hits / n_recipes >= 0.65 AND median_outside < 0.025 THEN 'in_hull' WHEN n_hits / n_recipes >= 0.35 OR median_outside < 0.06 THEN 'edge' ELSE 'outside_hull' END AS level FROM g""",
    "v20_loss_lattice": f"WITH {_FIELD} SELECT i, j, loss FROM lattice",
    "v20_box_minima": f"""WITH {_FIELD}, m AS (SELECT box_id, min({{'loss': loss, 'i': i, 'j': j}}) AS b FROM boxes JOIN lattice ON i BETWEEN p_low AND p_high AND j BETWEEN c_low AND c_high AND {STEPS} - i - j BETWEEN f_low AND f_high GROUP BY 1)
SELECT box_id, b.loss AS loss, b.i AS i, b.j AS j FROM m""",
    "v20_corridor": f"""WITH {_FIELD}, m AS (SELECT box_id, min({{'distance': (greatest(p_low - i, i - p_high, 0) + greatest(c_low - j, j - c_high, 0) + greatest(f_low - {STEPS} + i + j, {STEPS} - i - j - f_high, 0))::INT, 'i': i, 'j': j}}) AS b FROM boxes, basin GROUP BY 1)
SELECT box_id, b.distance AS distance, b.i AS i, b.j AS j FROM m""",
    "v20_basin": f"WITH {_FIELD} SELECT i, j, loss, threshold FROM basin",
}
QUERIES = {f.__name__: f for f in (v19_recipe_hulls, v19_source_hulls, x18_hull_context, v21_targets, v20_loss_lattice, v20_box_minima, v20_corridor, v20_basin, v4_spherical_kmeans, t9_farthest_points, t8_diverse_relevant, p4_diverse_sample)}
