"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scores, text
from millrace.operators import hierarchy, relational


def values(spark, column, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_has_volume(spark):
    assert values(spark, text.has_volume(F.col("x"), F.lit(None)), "fl oz", "2 fluid ounces", "cupcake", None) == [True, True, False, False]


def test_quantity(spark):
    assert values(spark, text.quantity(F.col("x")), "1 1/2", "3/4", "2.5", "some", "1/0", None) == [1.5, 0.75, 2.5, None, None, None]


def test_singular(spark):
    assert values(spark, text.singular(F.col("x")), "Tomatoes", "berries", "eggs", "glass") == ["tomato", "berry", "egg", "glass"]


def test_normalize_description(spark):
    assert values(spark, text.normalize_description(F.col("x")), "  Milk,  WHOLE (3%) ", None, "...") == ["milk whole 3", "", ""]


def test_jaccard_of_empty_sets(spark):
    none = F.array().cast("array<string>")
    one = F.array(F.lit("a"))
    row = spark.range(1).select(scores.jaccard(none, none), scores.jaccard(none, none, empty=1.0), scores.jaccard(none, one)).first()
    assert tuple(row) == (0.0, 1.0, 0.0)


@pytest.mark.parametrize(
    ("score", "margin", "tier"), [(0.75, 0.08, "high"), (0.75, 0.07, "medium"), (0.55, 0.0, "medium"), (0.40, 0.0, "low"), (0.39, 1.0, "unresolved")]
)
def test_match_tier(spark, score, margin, tier):
    assert spark.range(1).select(scores.match_tier(F.lit(score), F.lit(margin), 0.75, 0.55, 0.40, 0.08)).first()[0] == tier


def test_cosine_of_zero(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert spark.range(1).select(scores.cosine(zero, one)).first()[0] == 0.0


def test_units(spark):
    row = spark.range(1).select(
        scores.convert(F.lit(2.0), F.lit("cup"), F.lit("tablespoon")), scores.convert(F.lit(1.0), F.lit("cup"), F.lit("gram"))
    ).first()
    assert row[0] == pytest.approx(32, rel=1e-6) and row[1] is None


def test_closure_and_antichain(spark):
    paths = hierarchy.closure(spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string"))
    assert {tuple(r) for r in paths.where("node = 'c'").collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2)}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert [r[0] for r in hierarchy.deepest_antichain(nodes, paths).collect()] == ["c"]


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in relational.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_pareto_keeps_equal_points(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 1.0, 1.0), (0, 3, 2.0, 1.0)], "g int, k int, x double, y double")
    assert sorted(r["k"] for r in relational.pareto_front(rows, "g", "k", ["x", "y"]).collect()) == [1, 2]
