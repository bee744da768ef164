"""Session helpers: scratch tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (a local one only if unset), deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/kvloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no later step reads."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df to a scratch folder and read it back, which cuts its lineage and survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """The driver lets go of plans, broadcasts and shuffles that nothing refers to any more, and gives back the heap they took.

    Its heap grows by what many short jobs leave, faster where a shuffle has many partitions, and Spark removes broadcasts
    and shuffle files only when the driver's garbage is collected.
    """
    gc.collect()  # data frames in reference cycles hold their plans
    spark.sparkContext._jvm.System.gc()
