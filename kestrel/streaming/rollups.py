"""Roll-ups and bursts over streams; the same functions take batch DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Our own bound on state: events that are later than this are left out of a stream's results.
LATENESS = "10 minutes"


def rollup(events: DataFrame, width: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value", lateness: str = LATENESS) -> DataFrame:
    """Count and mean per window and key (R8); windows without events have no row, null times are left aside."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks take no zoneless times
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    grouped = rows.where(F.col(ts).isNotNull()).groupBy(F.window(ts, width).alias("w"), key)
    return grouped.agg(F.count("*").alias("events"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("start"), key, "events", "mean_value")


def bursts(events: DataFrame, quiet: str = "2 seconds", ts: str = "ts", key: str = "user_id", lateness: str = LATENESS) -> DataFrame:
    """A row per burst of a key's events, at the end of the quiet after it."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks take no zoneless times
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    grouped = rows.where(F.col(ts).isNotNull()).groupBy(key, F.session_window(ts, quiet).alias("w"))
    return grouped.agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("fires_at"), "events")
