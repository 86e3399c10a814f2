"""Windowed aggregates over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of a stream of events by event type and time window; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select("w.start", "w.end", "event_type", "events", "total")
    )
