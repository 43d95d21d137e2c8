"""Windowed aggregates and deduplication that run alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a zoned event time; a watermark bounds the state of a stream."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def tumbling(events: DataFrame, size: str, late: str = LATE) -> DataFrame:
    """n and total of each event type and window."""
    return _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = LATE) -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """One event a key: within the watermark on a stream, over all rows on a table."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)
