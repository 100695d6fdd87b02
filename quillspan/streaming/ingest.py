"""Incremental ingest of record files: a file stream whose batches are segmented and appended, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of JSON lines (doc_id, text) from a folder."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def unit_stream(records: DataFrame) -> DataFrame:
    """Sentence units of a stream of documents; there is no state, so nothing waits for late data."""
    return records.select("doc_id", F.explode(T.source_units(F.col("text"))).alias("u")).select("doc_id", "u.*")


def ingest(records: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the units of new files to a Parquet table; the checkpoint keeps what was read."""
    writer = unit_stream(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
