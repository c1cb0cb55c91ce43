"""The event computations as Structured Streaming: duplicates, windows and rates with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may be.
LATENESS = "30 minutes"


def _timed(events: DataFrame) -> DataFrame:
    """With a watermark on ``ts``, unless there is one."""
    if "spark.watermarkDelayMs" in events.schema["ts"].metadata:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def once(events: DataFrame) -> DataFrame:
    """Each event_id once, however often it is delivered within the lateness."""
    return _timed(events).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Events and their total value for each type and tumbling window."""
    return _timed(events).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def busy_users(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Users with at least ``limit`` events in a window of ``seconds`` that slides by half of that."""
    window = F.window("ts", f"{seconds} seconds", f"{max(1, seconds // 2)} seconds")
    return _timed(events).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events not further apart than ``gap``."""
    return _timed(events).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
