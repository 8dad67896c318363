"""Portions: every food has four portion rows whose texts come from its key; ingredient lines find their grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import parsing
from millrace.operators import portions
from millrace.operators.lineage import checkpointed
from millrace.plans.tables import foods, raw_lines

KEY = ["recipe_id", "line", "food_id", "source_id"]
#: Texts of portion rows: modifier, description, unit name.
TEXTS = (
    ("cup, chopped", "", "undetermined"), ("", "2 tbsp", ""), ("10205", "1 large", ""), ("medium", "", ""), ("can (15 oz)", "", ""),
    ("", "1 serving", "RACC"), ("12345", "", "undetermined"), ("large whole, approx 5 oz", "", ""), ("fl oz", "", ""), ("", "", "lb"),
    ("slice", "1 slice, thin", ""), ("", "3 small pieces", ""), ("jar", "", ""), ("", "", "cup"), ("piece", "", "each"),
)


def food_portions(spark, sf_dir):
    """food_id, portion_id, seq, data_points, gram_weight, amount, modifier, description, unit_name."""
    texts = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(t, ("modifier", "description", "unit_name"))]) for t in TEXTS])
    rows = foods(spark, sf_dir).select("food_id", "size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    rows = rows.withColumn("t", F.get(texts, F.pmod(F.col("food_id") * 7 + F.col("seq") * 4, F.lit(len(TEXTS))).cast("int")))
    weight = F.when((F.col("food_id") + F.col("seq")) % 11 == 0, 0.0).otherwise((F.col("size") * 5 + F.col("seq") * 10).cast("double"))
    return rows.select(
        "food_id", (F.col("food_id") * 4 + F.col("seq")).alias("portion_id"), "seq", ((F.col("food_id") * 3 + F.col("seq")) % 61).cast("int").alias("data_points"),
        weight.alias("gram_weight"), ((F.col("food_id") + F.col("seq")) % 3).cast("double").alias("amount"), "t.modifier", "t.description", "t.unit_name",
    )


def m4_portion_classes(spark, sf_dir):
    """The kind of every portion row, its unit, amount and label."""
    made = portions.classified(food_portions(spark, sf_dir))
    return made.select("portion_id", "kind", "ref_unit", "ref_amount", "label", "readable")


def m6_resolved_grams(spark, sf_dir):
    """Grams, status and portion of every ingredient line.  Lines of one text are parsed once, and lines of one
    food and text are resolved once."""
    lines = checkpointed(raw_lines(spark, sf_dir).select(*KEY, "raw"))
    parsed = parsing.with_bracketed_grams(parsing.parsed_lines(lines.select("raw").distinct()))
    parsed = checkpointed(parsed.select("raw", "quantity", F.when(F.col("unit") != "each", F.col("unit")).alias("unit"), "size", "name", "bracketed"))
    asked = lines.select("food_id", "raw").distinct().join(parsed, "raw")
    found = portions.resolved(asked, checkpointed(portions.classified(food_portions(spark, sf_dir))), ["food_id", "raw"])
    return lines.join(found, ["food_id", "raw"]).select(*KEY, "grams", "status", "portion_id", "path")


#: The rules are checked against the same rules row by row in the tests.
SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (m4_portion_classes, m6_resolved_grams)}
