"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs only the
tasks it was running.  The setting is read from the session; where it is unset, a local session
(tests, a laptop) uses a folder of this machine, and any other raises.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/millrace-checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The folder is marked for deletion when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop, files = _on_disk(spark, path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote; for tables whose readers have all been written themselves."""
    spark = table.sparkSession
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        hadoop, files = _on_disk(spark, path)
        if f"/{spark.sparkContext.applicationId}/" in path:
            files.delete(hadoop, True)


def _on_disk(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


Batches = Iterator[pa.RecordBatch]


def tidy(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` for mapInArrow that gives Arrow's unused memory back after a partition, as Python
    workers outlive the stages they serve."""

    def run(batches: Batches) -> Batches:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run
