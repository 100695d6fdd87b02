"""Intermediate tables in the folder that all machines share, and other small helpers of the session."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import dropped, shared_folder, stored

__all__ = ["documents", "dropped", "partitions", "release", "shared_folder", "stored"]


def release(spark: SparkSession) -> None:
    """Has the JVM collect its garbage, since Spark deletes shuffle files only of plans that are gone. The pause lets
    the last query's end be told to listeners, which hold its plan until then."""
    gc.collect()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
