"""Event-time streams over ``events``: windows, sessions and first-seen filters, with late data bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """With ``ts`` as an instant and a watermark on it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling, or with ``slide`` sliding, windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of a user's events at most ``gap`` apart."""
    grouped = timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event the first time it comes, state kept as long as it may be late."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])
