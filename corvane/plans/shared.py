"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose code would be one method of over 8,000 bytes, which the JVM never compiles, run as several meanwhile."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, or in the warehouse where that is unset; deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/streams-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MARKED.add(path)
    return path


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: they lie there until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stored_by(df: DataFrame, column: str, values: list[str], name: str) -> dict[str, DataFrame]:
    """df written to the shared folder in one pass, read back as a table for each value of the column, without it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    spark, schema = df.sparkSession, df.drop(column).schema
    at = {v: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}") for v in values}
    there = {v: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for v, p in at.items()}
    return {v: spark.read.schema(schema).parquet(f"{path}/{column}={v}") if there[v] else spark.createDataFrame([], schema) for v in values}
