"""Vectors: similarity, nearest neighbours, ranks, centroids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import scores
from millrace.operators import vectors
from millrace.plans.tables import foods, table

DIMENSIONS = 64
#: A stated list of queries; the table of them is broadcast, so it stays this short.
QUERY_IDS = (0, 7, 77, 300)


def _against_queries(spark, sf_dir):
    """(query_id, vec_id, label, similarity) of each stated query with all other vectors."""
    all_rows = table(spark, sf_dir, "embeddings")
    queries = all_rows.where(F.col("vec_id").isin(*QUERY_IDS)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = all_rows.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id"))
    return pairs.select("query_id", "vec_id", "label", F.round(scores.cosine(F.col("query"), F.col("embedding")), 6).alias("similarity"))


def v1_cosine(spark, sf_dir):
    return _against_queries(spark, sf_dir).select("query_id", "vec_id", "similarity")


def t1_top_by_cosine(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return _against_queries(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "vec_id", "rank")


def v2_neighbour_pairs(spark, sf_dir):
    """The ten nearest of every vector, at a cosine of 0.3 or more."""
    return vectors.neighbours(table(spark, sf_dir, "embeddings"), 10, 0.3, key="vec_id", vector="embedding")


def v3_hybrid_pairs(spark, sf_dir):
    """Neighbours scored by vectors, words and titles of the foods of the same ids."""
    meta = foods(spark, sf_dir).select("food_id", "description", F.split("description", " ").alias("w"))
    side = lambda end, key: meta.select(F.col("food_id").alias(key), F.col("description").alias(f"title_{end}"), F.col("w").alias(f"w_{end}"))
    pairs = v2_neighbour_pairs(spark, sf_dir).join(side("a", "vec_id"), "vec_id").join(side("b", "match"), "match")
    hybrid = 0.5 * F.col("similarity") + 0.35 * scores.jaccard(F.col("w_a"), F.col("w_b")) + 0.15 * scores.edit_ratio(F.col("title_a"), F.col("title_b"))
    return pairs.select("vec_id", "match", F.round(hybrid, 8).alias("hybrid"))


def v5_ranked(spark, sf_dir):
    """100 times a blend of similarity, held to 0 and 1, and a nutrient score of the food of the same id."""
    nutrient = foods(spark, sf_dir).select(F.col("food_id").alias("vec_id"), scores.fit_score(F.abs(F.col("size") - 25) / 10.0).alias("fit"))
    blend = 100 * (0.7 * F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0)) + 0.3 * F.col("fit"))
    scored = _against_queries(spark, sf_dir).join(nutrient, "vec_id").select("query_id", "vec_id", F.round(blend, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def v9_combined(spark, sf_dir):
    """Levels, vector and cuisine blended; without a vector the other weights take its place."""
    known, same = F.col("vec_id") % 10 != 0, (F.col("label") == F.col("query_id") % 10).cast("double")
    cuisine = F.when(F.col("vec_id") % 4 == F.col("query_id") % 4, 1.0).otherwise(0.0)
    semantic = F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0))
    blend = F.when(known, 0.5 * same + 0.35 * semantic + 0.15 * cuisine).otherwise((0.5 * same + 0.15 * cuisine) / 0.65)
    return _against_queries(spark, sf_dir).select("query_id", "vec_id", F.round(blend, 9).alias("combined"))


def ag34_centroids(spark, sf_dir):
    made = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", DIMENSIONS)
    return made.select("label", F.posexplode("centroid").alias("place", "x")).select("label", "place", F.round("x", 5).alias("x"))


def t11_medoids(spark, sf_dir):
    """Per label the vector nearest to the centroid."""
    rows = table(spark, sf_dir, "embeddings")
    centres = vectors.centroids(rows, "label", "embedding", DIMENSIONS)
    near = F.round(scores.dot(F.col("embedding"), F.col("centroid")), 5)
    return rows.join(centres, "label").groupBy("label").agg(F.min_by("vec_id", F.struct(-near, F.col("vec_id"))).alias("medoid"))


def v15_mean_distance(spark, sf_dir):
    """Mean cosine distance of a label's pairs: the squared sum of unit vectors holds all their products."""
    rows = table(spark, sf_dir, "embeddings").select("label", vectors.unit("embedding").alias("u"))
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[k]).alias(f"s{k}") for k in range(DIMENSIONS)])
    square = sum((F.col(f"s{k}") * F.col(f"s{k}") for k in range(DIMENSIONS)), F.lit(0.0))
    return sums.where("n > 1").select("label", F.round(1 - (square - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("mean_distance"))


_UNIT = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
_Q = f"WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS similarity FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id IN {QUERY_IDS})"
_NEAR = f"""WITH {_UNIT}, p AS (SELECT a.vec_id, b.vec_id AS match, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM p WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match) <= 10)"""
_CENTRES = f"""WITH {_UNIT}, m AS (SELECT label, i AS place, avg(v[i + 1]) AS x FROM e, range({DIMENSIONS}) r(i) GROUP BY 1, 2), c AS (SELECT label, place, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"""
SQL = {
    "v1_cosine": _Q + " SELECT query_id, vec_id, similarity FROM s",
    "t1_top_by_cosine": _Q + " SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10",
    "v2_neighbour_pairs": _NEAR + " SELECT * FROM near",
    "v3_hybrid_pairs": _NEAR + """, f AS (SELECT p_partkey AS id, p_name AS t, string_split(p_name, ' ') AS w FROM part)
SELECT vec_id, match, round(0.5 * similarity + 0.35 * len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) + 0.15 * (1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))), 8)::DOUBLE AS hybrid FROM near JOIN f a ON a.id = vec_id JOIN f b ON b.id = match""",
    "v5_ranked": _Q + """, r AS (SELECT query_id, vec_id, round(100 * (0.7 * least(greatest(similarity, 0.0), 1.0) + 0.3 / (1 + abs(p_size - 25) / 10.0::DOUBLE)), 6) AS score FROM s JOIN part ON p_partkey = vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM r""",
    "v9_combined": _Q + """, k AS (SELECT *, (label = query_id % 10)::INT::DOUBLE AS same, (vec_id % 4 = query_id % 4)::INT::DOUBLE AS cuisine FROM s)
SELECT query_id, vec_id, round(CASE WHEN vec_id % 10 <> 0 THEN 0.5 * same + 0.35 * least(greatest(similarity, 0.0), 1.0) + 0.15 * cuisine ELSE (0.5 * same + 0.15 * cuisine) / 0.65 END, 9)::DOUBLE AS combined FROM k""",
    "ag34_centroids": _CENTRES + " SELECT label, place::INT AS place, round(x, 5) AS x FROM c",
    "t11_medoids": _CENTRES + """, d AS (SELECT e.label, vec_id, round(sum(v[place + 1] * x), 5) AS d FROM e JOIN c USING (label) GROUP BY 1, 2)
SELECT label, vec_id AS medoid FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) = 1""",
    "v15_mean_distance": f"WITH {_UNIT} SELECT a.label, round(avg(1 - list_dot_product(a.v, b.v) / (a.n * b.n)), 5) AS mean_distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
