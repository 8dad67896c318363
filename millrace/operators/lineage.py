"""Cutting lineage in iterative operators, and tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names and read back.

    Only a local session without that setting uses a folder of this machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables of this application, below the one that ``spark.checkpoint.dir`` names; only a
    local session without that setting uses a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """``df`` written as compressed Parquet to a new scratch folder and read back.

    Unlike a checkpoint it is compressed, readers take only the columns they need, and its size is known, so small
    tables are broadcast.  The folder is marked for deletion when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
