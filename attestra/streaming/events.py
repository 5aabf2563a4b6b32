"""Structured Streaming over event tables; beyond what the survey's system has, which knows batches only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of ``folder`` as a stream; the schema comes from what is there already."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count and sum of values by window and type; repeated event ids inside the watermark count once."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    once = stamped.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else stamped.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
