"""Literal cases of ingredient lines, and neighbours over several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import parsing, scores, text
from millrace.operators import vectors


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("1 1/2 cups flour, sifted", (1.5, "cup", None, "flour, sifted", None, "parsed")),
        ("2 large eggs, beaten", (2.0, "each", "large", "eggs", "beaten", "parsed_size_as_count")),
        ("3 ripe bananas", (3.0, "each", None, "ripe bananas", None, "quantity_no_known_unit")),
        ("salt to taste", (None, None, None, "salt to taste", None, "no_quantity")),
        ("1 T. chopped fresh dill", (1.0, "tablespoon", None, "dill", "chopped, fresh", "parsed")),
        ("", (None, None, None, "", None, "no_quantity")),
    ],
)
def test_parsed_line(spark, line, expected):
    row = spark.createDataFrame([(line,)], "x string").select(parsing.parsed_line(F.col("x")).alias("p")).select("p.*").first()
    assert tuple(row)[:6] == expected


def test_amounts_and_marks(spark):
    lit = F.lit
    row = spark.range(1).select(
        parsing.bracketed_grams(lit("1 can (about 8 oz.) beans")), parsing.bracketed_grams(lit("1 can beans")),
        parsing.amount_kind(lit(1.0), lit("pinch"), lit("salt")), parsing.amount_kind(lit(1.0), lit("bunch"), lit("dill")), parsing.amount_kind(lit(None), lit("cup"), lit("x")),
        parsing.units_in_text(lit("2 T sugar and 1 t salt")), text.clean_ingredient(lit("2 cups flour (sifted)")), text.display_label(lit("2 (x) 3")),
        scores.label_match(lit("rice"), lit("rice flour")), scores.containment_bonus(F.array(lit("a"), lit("b")), F.array(lit("a"))),
    ).first()
    assert row[0] == pytest.approx(226.796185) and tuple(row)[1:8] == (None, "volume", "unknown", "unmeasurable", "2 tablespoon sugar and 1 teaspoon salt", "flour", None)
    assert row[8] == pytest.approx(0.952) and row[9] == pytest.approx(0.5)


def test_neighbours_over_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 13)
    made = np.random.default_rng(5).normal(size=(60, 4)).round(2)
    made[7] = made[3]
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(made)], "id long, vector array<double>")
    found = {(r["id"], r["match"]) for r in vectors.neighbours(rows, 3, 0.5).collect()}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    cosine = (unit @ unit.T).round(6)
    expected = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and cosine[i, j] >= 0.5), key=lambda j: (-cosine[i, j], j))[:3]}
    assert found == expected
