"""Structured Streaming over landing folders: an extension, not part of the batch catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """The stream of files that arrive in a folder, with the path of each row's file."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.withColumn("prov_file", F.col("_metadata.file_path"))


def ingest_stream(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch to ``write``; a batch that is repeated after a failure comes with the same number."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sum of ``value`` per window and group; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: redelivered rows drop out."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
