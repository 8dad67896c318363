"""The tables that the queries read: recipes are orders, ingredient lines are order lines, foods are
parts, the ontology hangs suppliers below nations below regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recipe_lines(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """recipe_id, line, food_id, source_id, grams, status and the columns ``more``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("recipe_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("food_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_quantity").alias("grams"),
        F.col("l_returnflag").alias("status"),
        *more,
    )


def foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """food_id, description, brand, data_type, size, amount."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("food_id"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("data_type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("amount"),
    )


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (child, parent): S supplier, N nation, R region."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    suppliers = table(spark, sf_dir, "supplier").select(node("S", "s_suppkey").alias("child"), node("N", "s_nationkey").alias("parent"))
    return suppliers.unionByName(table(spark, sf_dir, "nation").select(node("N", "n_nationkey").alias("child"), node("R", "n_regionkey").alias("parent")))


def leaf(column: str) -> Column:
    """The ontology node of a supplier key."""
    return F.concat(F.lit("S"), F.col(column).cast("string"))


# Ingredient lines as text are put together from these, by the keys of a line.
AMOUNTS = ("1 1/2", "3/4", "two", "2.5", "12", "a", "some")
UNIT_WORDS = ("cups", "tbsp", "oz.", "large", "cans", "T", "lbs", "pinch of", "")
NOTES = ("", "(about 8 oz.)", ", chopped", "and salt", "(1 1/2 lbs)")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, line, food_id, source_id, description, raw: ingredient lines as text."""
    pick = lambda words, c: F.array(*[F.lit(w) for w in words])[F.pmod(F.col(c), F.lit(len(words))).cast("int")]
    raw = F.concat_ws(" ", pick(AMOUNTS, "food_id"), pick(UNIT_WORDS, "source_id"), "description", pick(NOTES, "recipe_id"))
    lines = recipe_lines(spark, sf_dir).join(foods(spark, sf_dir).select("food_id", "description"), "food_id")
    return lines.select("recipe_id", "line", "food_id", "source_id", "description", F.trim(F.regexp_replace(raw, " +", " ")).alias("raw"))
