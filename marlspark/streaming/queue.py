"""The work queue on a stream of events: the same state machine as operators.queue, with state per URL.

Of a URL the stream keeps a settled item (all its events up to the watermark, in
order) and a list of later events that may still be preceded by others. Every
batch gives the item as it stands, whatever order events came in; when the
watermark passes, the list is folded into the item by a timer. Timers also put
back what has been processing for too long, and drop items that ended long ago.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "url string, doc_type string, status string, retry_count bigint, added_at timestamp, updated_at timestamp"
_ITEM = "doc_type string, status string, retry_count bigint, added bigint, updated bigint"
_EVENT = "us bigint, event_id bigint, event string, doc_type string"
_RAW = "url string, doc_type string, status string, retry_count bigint, added bigint, updated bigint"
HOUR = 3_600_000_000


def advance(state: tuple | None, event: str, at, max_retries: int) -> tuple | None:
    """The state after one event; None before the first enqueueing."""
    if state is None:
        return ("pending", 0, at, at) if event == "enqueue" else None
    status, retries, added, updated = state
    if event == "start":
        return "processing", retries, added, at
    if event == "complete":
        return "completed", retries, added, at
    if event == "fail":
        return ("failed" if retries + 1 >= max_retries else "pending"), retries + 1, added, at
    return state


class Items(StatefulProcessor):
    """One URL's item. stuck, keep: microseconds after which an item that is processing is pending again, and one that has ended is dropped; None is never."""

    def __init__(self, max_retries: int, stuck: int | None, keep: int | None):
        self.max_retries, self.stuck, self.keep = max_retries, stuck, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _ITEM)
        self.waiting = handle.getListState("waiting", _EVENT)

    def _fold(self, item: tuple | None, kind: str | None, events: list[tuple]) -> tuple[tuple | None, str | None]:
        for us, _, event, doc_type in sorted(events, key=lambda e: e[:2]):
            if item and self.stuck is not None and item[0] == "processing" and us > item[3] + self.stuck:
                item = ("pending", item[1], item[2], item[3] + self.stuck)
            if item is None and event == "enqueue":
                kind = doc_type
            item = advance(item, event, us, self.max_retries)
        return item, kind

    def _settled(self, key: tuple, events: list[tuple], watermark: int) -> Iterator[Row]:
        """Fold what the watermark has passed, keep the rest, and give the item as it stands."""
        item, kind = None, None
        if self.item.exists():
            kind, *state = self.item.get()
            item = tuple(state)
        due, later = [e for e in events if e[0] <= watermark], [e for e in events if e[0] > watermark]
        item, kind = self._fold(item, kind, due)
        if item and self.stuck is not None and item[0] == "processing" and item[3] + self.stuck <= watermark:
            item = ("pending", item[1], item[2], item[3] + self.stuck)
        gone = item and self.keep is not None and item[0] in ("completed", "failed") and item[3] + self.keep <= watermark
        if gone:
            yield Row(url=key[0], doc_type=kind, status="expired", retry_count=item[1], added=item[2], updated=item[3])
            item, kind = None, None
        if item:
            self.item.update((kind, *item))
        else:
            self.item.clear()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [min(e[0] for e in later)] if later else []
        if item and self.stuck is not None and item[0] == "processing":
            times.append(item[3] + self.stuck)
        if item and self.keep is not None and item[0] in ("completed", "failed"):
            times.append(item[3] + self.keep)
        for t in {-(-t // 1000) for t in times}:
            self.handle.registerTimer(t)
        now, kind = self._fold(item, kind, later)
        if now:
            yield Row(url=key[0], doc_type=kind, status=now[0], retry_count=now[1], added=now[2], updated=now[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        events += [(r.us, r.event_id, r.event, r.doc_type) for r in rows]
        yield from self._settled(key, events, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settled(key, events, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def _with_rocks(spark: SparkSession) -> None:
    """Several states of a key need the store that keeps column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def queue_updates(events: DataFrame, max_retries: int = 3, delay: str = "1 day", stuck_hours: float | None = None, keep_days: float | None = None) -> DataFrame:
    """A stream of changed items from a stream of events (url, event, at, event_id, and doc_type if there is one).

    An event may come `delay` after later ones. With stuck_hours, what is processing for longer is
    pending again; with keep_days, what has completed or failed so long ago is given once as `expired` and forgotten.
    """
    _with_rocks(events.sparkSession)
    kind = F.col("doc_type") if "doc_type" in events.columns else F.lit(None).cast("string")
    e = events.select("url", "event", "event_id", kind.alias("doc_type"), F.unix_micros("at").alias("us"), "at").withWatermark("at", delay)
    stuck, keep = (None if x is None else int(x * unit) for x, unit in ((stuck_hours, HOUR), (keep_days, 24 * HOUR)))
    out = e.groupBy("url").transformWithState(Items(max_retries, stuck, keep), _RAW, "Update", "EventTime")
    return out.select("url", "doc_type", "status", "retry_count", F.timestamp_micros("added").alias("added_at"), F.timestamp_micros("updated").alias("updated_at"))


def newest(batch: DataFrame) -> DataFrame:
    """A batch's last update of each URL."""
    w = Window.partitionBy("url").orderBy(F.col("updated_at").desc(), F.col("retry_count").desc(), F.col("status"))
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dispatch(batch: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], default: str = "pdf") -> None:
    """Give each handler the pending items of its type; an item without a type is of the default one, and types without a handler wait."""
    pending = batch.filter("status = 'pending'").withColumn("doc_type", F.coalesce("doc_type", F.lit(default)))
    for kind, handle in handlers.items():
        handle(pending.filter(F.col("doc_type") == kind))


def run_available(updates: DataFrame, sink, checkpoint: str):
    """Process what is there and stop; sink(batch, epoch) must bear to see an epoch again."""
    return updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
