"""What changes over time: the queue as a stream, downloads' methods, versions of the store, staleness, stored settings; and batches for an encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.settings import STEPS, VALID, migrated
from ..operators import cache as C
from ..operators import chunking as K
from ..operators import methods as M
from ..registry import query
from ..sources.shared import fresh_path, materialize
from ..sources.tables import as_of, events, table
from ..sources.versions import Versions, purged
from ..streaming import queue as stream_queue
from .store import _NOW, _QUEUE, _RETRIES

# --- the queue ---


@query(f"WITH {_QUEUE} SELECT * FROM state")
def queue_streamed(spark, sf_dir):
    """The queue's state from a stream whose events are shuffled over five batches."""
    e = events(spark, sf_dir).select("event_id", "url", "event", "at")
    mixed = materialize(e.repartition(5, F.xxhash64("event_id")), "events")
    found = fresh_path(spark, "updates")

    def sink(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{found}/epoch={epoch}")

    stream = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(mixed.stored_at)
    stream_queue.run_available(stream_queue.queue_updates(stream, _RETRIES, delay="1000 days"), sink, fresh_path(spark, "checkpoint")).awaitTermination()
    every = spark.read.parquet(found)
    last = every.groupBy("url").agg(F.max_by(F.struct("status", "retry_count", "added_at", "updated_at"), "epoch").alias("s"))
    return last.select("url", "s.*")


# --- methods of a domain ---


@query(
    """WITH a AS (SELECT 'd' || user_id % 40 AS domain, event_id, ts, event_type IN ('error', 'click') AS bad, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'bot_detection' END AS reason FROM events WHERE event_type NOT IN ('signup', 'view')),
    l AS (SELECT *, lag(bad) OVER w AS p1, lag(bad, 2) OVER w AS p2 FROM a WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id)),
    m AS (SELECT 'd' || user_id % 40 AS domain, CASE event_id % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'requests' ELSE 'auto' END AS method, 'u' || user_id % 7 AS usr, ts FROM events WHERE event_type = 'signup' AND event_id % 50 = 0),
    r AS (SELECT domain, max(ts) AS reset_at FROM m WHERE method = 'auto' GROUP BY domain), c AS (SELECT domain, arg_max({'method': method, 'usr': usr, 'ts': ts}, (ts, method, usr)) AS c FROM m GROUP BY domain),
    s AS (SELECT l.domain, arg_min({'ts': ts, 'reason': reason}, (ts, event_id)) AS s FROM l LEFT JOIN r ON r.domain = l.domain WHERE bad AND p1 AND p2 AND (reset_at IS NULL OR ts > reset_at) GROUP BY l.domain),
    d AS (SELECT DISTINCT 'd' || user_id % 40 AS domain FROM events WHERE event_type <> 'signup' UNION SELECT domain FROM m),
    j AS (SELECT d.domain, s.s AS s, nullif(c.c.method, 'auto') AS held, c.c AS c FROM d LEFT JOIN s USING (domain) LEFT JOIN c USING (domain))
    SELECT domain, coalesce(held, CASE WHEN s IS NOT NULL THEN 'browser' END, 'auto') AS preferred, coalesce(held, CASE WHEN s IS NOT NULL THEN 'browser' END, 'requests') AS next_method,
    CASE WHEN held IS NOT NULL THEN 'manual:' || c.usr ELSE s.reason END AS reason, s.ts AS switched_at, CASE WHEN s IS NOT NULL THEN '3_failures' END AS "trigger", held AS manual_method, CASE WHEN held IS NOT NULL THEN c.ts END AS manual_at FROM j"""
)
def domain_methods(spark, sf_dir):
    """Domains' methods after failures in a row, choices and resets."""
    e = table(spark, sf_dir, "events").withColumn("domain", F.concat(F.lit("d"), F.col("user_id") % 40)).withColumn("at", F.col("ts").cast("timestamp"))
    k = F.col("event_type")
    reason = F.when(k == "error", "timeout").when(k == "click", "bot_detection")
    attempts = e.filter(k != "signup").select("domain", F.when(k == "view", "browser").otherwise("requests").alias("method"), (~k.isin("error", "click")).alias("success"), reason.alias("reason"), "at", F.col("event_id").alias("attempt_id"))
    which = F.when(F.col("event_id") % 3 == 0, "browser").when(F.col("event_id") % 3 == 1, "requests").otherwise("auto")
    manual = e.filter((k == "signup") & (F.col("event_id") % 50 == 0)).select("domain", which.alias("method"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("user"), "at")
    return M.preferences(attempts, manual)


# --- the store's versions ---

_CHILDREN = {"customer": [("orders", "o_custkey", "c_custkey")], "orders": [("lineitem", "l_orderkey", "o_orderkey")]}


@query(
    """WITH o AS (SELECT * FROM orders), gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3), left_o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)),
    t AS (SELECT 1 AS version, 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 1, 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 1, 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem
    UNION ALL SELECT 2, 'customer', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 7 <> 3 UNION ALL SELECT 2, 'orders', count(*), sum(o_orderkey)::BIGINT FROM left_o
    UNION ALL SELECT 2, 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem JOIN left_o ON o_orderkey = l_orderkey) SELECT * FROM t"""
)
def store_purged(spark, sf_dir):
    """Customers are purged with their orders and lines, as one version; who holds the version before goes on seeing it."""
    store = Versions(spark, fresh_path(spark, "store"))
    first = store.publish({"customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")})
    store.publish(purged(first, _CHILDREN, "customer", first["customer"].filter("c_custkey % 7 = 3"), "c_custkey"), first)
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    found = None
    for version in (first, store.open()):
        for name, key in keys.items():
            one = version[name].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).select(F.lit(version.number).alias("version"), F.lit(name).alias("name"), "n", "keys")
            found = one if found is None else found.unionByName(one)
    return found


@query(
    f"""WITH u AS (SELECT 'doc/' || user_id AS url, min(CASE WHEN event_type = 'view' THEN ts END) AS published_at FROM events GROUP BY user_id),
    m AS (SELECT 'doc/' || user_id AS url, CASE WHEN user_id % 2 = 0 THEN 'stale' ELSE 'revalidate' END AS cache_state, CASE WHEN user_id % 5 = 0 THEN {_NOW} + INTERVAL 2 HOUR END AS revalidate_after FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') WHERE user_id % 3 <> 0)
    SELECT u.url, published_at, CASE WHEN m.url IS NULL THEN 'fresh' ELSE m.cache_state END AS cache_state, CASE WHEN m.url IS NULL THEN NULL WHEN m.revalidate_after IS NOT NULL THEN m.revalidate_after
      WHEN published_at IS NOT NULL AND epoch_us({_NOW}) - epoch_us(published_at) < 30 * 86400000000 THEN {_NOW} + INTERVAL 24 HOUR ELSE {_NOW} + INTERVAL 7 DAY END AS revalidate_after FROM u LEFT JOIN m USING (url)"""
)
def url_staleness(spark, sf_dir):
    """Documents marked stale or to be validated again; without a time of their own, it follows from their age."""
    e = events(spark, sf_dir)
    urls = e.groupBy("url").agg(F.min(F.when(F.col("event") == "start", F.col("at"))).alias("published_at")).select("url", "published_at", F.lit("fresh").alias("cache_state"), F.lit(None).cast("timestamp").alias("revalidate_after"))
    n = F.substring_index("url", "/", -1).cast("bigint")
    marks = e.filter("event = 'touch'").select("url").distinct().filter(n % 3 != 0)
    marks = marks.select("url", F.when(n % 2 == 0, "stale").otherwise("revalidate").alias("cache_state"), F.when(n % 5 == 0, as_of() + F.expr("INTERVAL 2 HOURS")).alias("revalidate_after"))
    return C.mark_staleness(urls, marks, as_of())


@query(
    """WITH a AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok, 'code ' || event_id % 9 AS error FROM events WHERE event_type IN ('purchase', 'error')),
    g AS (SELECT user_id, max(ts) AS moved, arg_max(ok, (ts, event_id)) AS good, max((ts, event_id)) FILTER (ok) AS last_ok, arg_max(error, (ts, event_id)) FILTER (NOT ok) AS error FROM a GROUP BY user_id),
    f AS (SELECT a.user_id, count(*) AS failures FROM a JOIN g ON g.user_id = a.user_id WHERE NOT ok AND (last_ok IS NULL OR (a.ts, a.event_id) > last_ok) GROUP BY a.user_id)
    SELECT 'doc/' || g.user_id AS url, last_ok IS NOT NULL AS extracted, good AS processed, coalesce(failures, 0) AS failures, NOT good AND coalesce(failures, 0) >= 2 AS given_up, CASE WHEN NOT good THEN error END AS error,
    CASE WHEN last_ok IS NOT NULL THEN substr(text, 1, 1000) END AS preview, CASE WHEN last_ok IS NOT NULL THEN length(text)::INT END AS n_chars, CASE WHEN good THEN moved + INTERVAL 30 DAY END AS revalidate_after
    FROM g LEFT JOIN f USING (user_id) LEFT JOIN documents ON doc_id = g.user_id"""
)
def pdf_processing(spark, sf_dir):
    """Documents' processing attempts as flags, previews, next validations and failures."""
    e = events(spark, sf_dir).select("url", "event", "at", "event_id", F.concat(F.lit("code "), F.col("event_id") % 9).alias("error"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"), "text")
    return C.pdf_records(e.filter("event IN ('complete', 'fail')"), d)


# --- settings ---

_VALID = ", ".join(f"'{v}'" for v in VALID)


@query(
    f"""WITH s AS (SELECT event_id, event_id % 5 AS v, CASE event_type WHEN 'signup' THEN [{{'k': 'enable_processing_cache', 'v': 'true'}}, {{'k': 'max_cache_size_mb', 'v': (user_id * 40)::VARCHAR}}, {{'k': 'serper_freshness_days', 'v': '7'}}]
      WHEN 'view' THEN [{{'k': 'normal_revalidate_days', 'v': '3'}}, {{'k': 'recent_content_threshold_days', 'v': (event_id % 90)::VARCHAR}}, {{'k': 'revalidation_threshold_days', 'v': '1'}}]
      WHEN 'error' THEN [] ELSE [{{'k': 'enable_html_cache', 'v': 'false'}}, {{'k': 'error_cache_days', 'v': (user_id % 9)::VARCHAR}}, {{'k': 'unknown', 'v': '"x"'}}] END AS m FROM events),
    s1 AS (SELECT event_id, v, CASE WHEN v >= 1 THEN m ELSE list_transform(list_filter(m, lambda e: e.k NOT IN ('serper_freshness_days', 'enable_pdf_cache')), lambda e: {{'k': CASE WHEN e.k = 'enable_processing_cache' THEN 'enable_html_cache' ELSE e.k END, 'v': e.v}}) END AS m FROM s),
    s2 AS (SELECT event_id, v, CASE WHEN v >= 2 THEN m ELSE list_transform(list_filter(m, lambda e: e.k NOT IN ('recent_news_revalidate_hours', 'normal_revalidate_days') AND NOT (e.k = 'revalidation_threshold_days' AND len(list_filter(m, lambda x: x.k = 'recent_content_threshold_days')) > 0)),
      lambda e: {{'k': CASE WHEN e.k = 'recent_content_threshold_days' THEN 'revalidation_threshold_days' ELSE e.k END, 'v': e.v}}) END AS m FROM s1),
    s3 AS (SELECT event_id, v, CASE WHEN v >= 3 THEN m ELSE list_transform(m, lambda e: CASE WHEN e.k = 'max_cache_size_mb' THEN {{'k': 'max_cache_size_gb', 'v': greatest(1, e.v::BIGINT // 1024)::VARCHAR}} ELSE e END) END AS m FROM s2),
    s4 AS (SELECT event_id, v, CASE WHEN v >= 4 THEN m ELSE list_concat(list_filter(m, lambda e: e.k IN ({_VALID})), list_filter([{{'k': 'enable_html_cache', 'v': 'true'}}, {{'k': 'max_cache_size_gb', 'v': '100'}}, {{'k': 'revalidation_threshold_days', 'v': '15'}}], lambda e: NOT list_contains(list_transform(m, lambda x: x.k), e.k))) END AS m FROM s3)
    SELECT event_id, '{{' || array_to_string(list_transform(list_sort(m), lambda e: '"' || e.k || '":' || e.v), ',') || '}}' AS settings FROM s4"""
)
def settings_migrated(spark, sf_dir):
    """Stored settings of five versions, brought to the newest."""
    k = F.col("event_type")
    text = (
        F.when(k == "signup", F.concat(F.lit('{"enable_processing_cache": true, "serper_freshness_days": 7, "max_cache_size_mb": '), F.col("user_id") * 40, F.lit("}")))
        .when(k == "view", F.concat(F.lit('{"recent_content_threshold_days": '), F.col("event_id") % 90, F.lit(', "normal_revalidate_days": 3, "revalidation_threshold_days": 1}')))
        .when(k == "error", F.lit("[]"))
        .otherwise(F.concat(F.lit('{"enable_html_cache": false, "unknown": "x", "error_cache_days": '), F.col("user_id") % 9, F.lit("}")))
    )
    return table(spark, sf_dir, "events").select("event_id", migrated(text, F.col("event_id") % 5, STEPS).alias("settings"))


# --- batches ---


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), n AS MATERIALIZED (SELECT doc_id, line_no, length(line) AS n_chars FROM l),
    b AS (SELECT doc_id, line_no, n_chars, 0 AS batch_no, 1 AS items, n_chars AS total FROM n WHERE line_no = 0
      UNION ALL SELECT n.doc_id, n.line_no, n.n_chars, CASE WHEN items >= 4 OR total + n.n_chars > 600 THEN batch_no + 1 ELSE batch_no END, CASE WHEN items >= 4 OR total + n.n_chars > 600 THEN 1 ELSE items + 1 END, CASE WHEN items >= 4 OR total + n.n_chars > 600 THEN n.n_chars ELSE total + n.n_chars END
      FROM b JOIN n ON n.doc_id = b.doc_id AND n.line_no = b.line_no + 1)
    SELECT doc_id, line_no, n_chars, batch_no FROM b"""
)
def line_batches(spark, sf_dir):
    """Lines of documents in batches for an encoder: four lines and 600 characters at most, anew for each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return K.batches(lines.select("doc_id", "line_no", F.length("line").alias("n_chars")), "doc_id", "line_no", "n_chars", 4, 600)
