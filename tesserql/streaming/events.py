"""Windowed rollups over a stream of events.

An extension of this package's own: the dialect has no streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark if they stream; that asks for a zoned time."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; state is bounded by the watermark."""
    return (
        timed(events, late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """One row for each user's run of events without a longer pause."""
    return (
        timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")
    )


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without repeats, among those that the watermark still holds."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])
