"""Event-time windows over a static or streaming table of (url, event, at, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("at", delay) if events.isStreaming and delay else events


def tumbling(events: DataFrame, size: str, slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Counts and sums by window and event. A stream gives a window once its watermark has passed."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return _late(events, delay).groupBy(w.alias("window"), "event").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, delay: str | None = "1 hour") -> DataFrame:
    """Runs of a URL's events with less than `gap` between neighbours."""
    return _late(events, delay).groupBy(F.session_window("at", gap).alias("session"), "url").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream's events without repeated ids within the watermark; a table's without repeated ids."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
