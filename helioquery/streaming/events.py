"""Windowed aggregation of an event stream; the same plan runs over a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values per window and type; on a stream, state is dropped ``late`` after a window."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def read_events(spark: SparkSession, folder: str, sample: DataFrame) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of a sample."""
    return spark.readStream.schema(sample.schema).parquet(folder)
