"""Files in and out: typed CSV, nested JSON lines, Parquet by ids, pages by key, reports, table upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType, names: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes and empty fields as null; columns go by place.

    ``schema`` names the columns as they shall be called, whatever the header says; ``names`` picks
    and orders them.  A field that does not fit its type fails the read.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(*names) if names else rows


def read_documents(spark: SparkSession, path: str, schema: str | StructType, paths: Mapping[str, str]) -> DataFrame:
    """JSON lines with nested fields, flattened: ``paths`` maps a column to its place, such as ``_id.$oid``."""
    quoted = lambda place: F.col(".".join(f"`{part}`" for part in place.split(".")))
    return spark.read.schema(schema).json(path).select(*[quoted(place).alias(name) for name, place in paths.items()])


def read_by_ids(spark: SparkSession, path: str, key: str, ids: Sequence[int]) -> DataFrame:
    """The rows of a Parquet table with one of a short list of ids; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(key).isin(list(ids)))


def page_after(table: DataFrame, key: str, last: int | None, size: int) -> DataFrame:
    """The next ``size`` rows by key after ``last``: a paged reader's step, cut on each partition first."""
    rows = table if last is None else table.where(F.col(key) > last)
    return rows.orderBy(key).limit(size)


def write_report(report: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a report over what was there; CSV with a header."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind of report: {kind}")
    writer = report.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def refreshed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete then insert: all rows of ``old`` whose keys occur in ``new`` go, all rows of ``new`` come."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def without_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` with keys that ``old`` has are skipped; of equal new keys one row comes."""
    fresh = new.join(old.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))
    return old.unionByName(fresh, allowMissingColumns=True)


def with_columns(table: DataFrame, wanted: StructType) -> DataFrame:
    """The table with the wanted columns that it lacks, as nulls; those it has keep their type."""
    have = set(table.columns)
    return table.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in have])


def described(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of all columns."""
    return [(name, field.name, field.dataType.simpleString()) for name, table in tables.items() for field in table.schema]


def named_joins(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, its key) where a column is called after another table and its ``id``."""
    return [
        (name, column, other, "id")
        for name, table in tables.items()
        for column in table.columns
        for other, target in tables.items()
        if other != name and column == f"{other}_id" and "id" in target.columns
    ]
