"""The work queue as a fold of events, in batch; its streaming face is in streaming.queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days

STATES = ("pending", "processing", "completed", "failed")


def queue_state(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """Each URL's status and retry count from its events (url, event, at, event_id).

    An item exists from its first enqueueing on; later ones are ignored. A failure counts a
    retry and makes the item pending again, or failed at the last. Every URL's events become
    one row of aggregates in each task; none is gathered.
    """
    order = F.struct("at", "event_id")
    of = lambda *k: F.when(F.col("event").isin(*k), order)
    first = events.groupBy("url").agg(F.min(of("enqueue")).alias("added"))
    live = events.join(first.filter("added IS NOT NULL"), "url").filter(order > F.col("added"))
    s = live.groupBy("url").agg(F.max_by("event", of("start", "complete", "fail")).alias("last"), F.max(of("start", "complete", "fail")).alias("moved"), F.count_if(F.col("event") == "fail").alias("retry_count"))
    every = first.filter("added IS NOT NULL").join(s, "url", "left")
    retries = F.coalesce("retry_count", F.lit(0))
    status = F.when(F.col("last") == "start", "processing").when(F.col("last") == "complete", "completed").when((F.col("last") == "fail") & (retries >= max_retries), "failed").otherwise("pending")
    return every.select("url", status.alias("status"), retries.alias("retry_count"), F.col("added.at").alias("added_at"), F.coalesce("moved.at", "added.at").alias("updated_at"))


def queue_stats(state: DataFrame) -> DataFrame:
    """Items by status; every status has a row."""
    every = state.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(state.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def next_pending(state: DataFrame, n: int = 1, max_retries: int = 3) -> DataFrame:
    """The oldest items that may be tried."""
    return state.filter((F.col("status") == "pending") & (F.col("retry_count") < max_retries)).orderBy("added_at", "url").limit(n)


def clear_completed(state: DataFrame, as_of: Column, days: float = 7) -> DataFrame:
    return state.filter(~((F.col("status") == "completed") & (age_days(as_of, F.col("updated_at")) > days)))


def reset_stuck(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def lane(cached: Column, status: Column, size_mb: Column, seconds: Column, most_mb: float = 10, most_seconds: float = 6) -> Column:
    """Where a request goes: the cache, its place in the queue, the background for what is large or slow, else the fast lane."""
    return F.when(cached, "cache").when(status.isin("pending", "processing"), "queued").when(status == "failed", "failed").when((size_mb > most_mb) | (seconds > most_seconds), "background").otherwise("fast")


def last_completed(state: DataFrame, n: int = 10) -> DataFrame:
    """The items that were completed last. Equal times go by url."""
    return state.filter("status = 'completed'").orderBy(F.col("updated_at").desc(), "url").limit(n)
