"""Vectors, the cache, downloads and the queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import cache as C
from ..operators import queue as Q
from ..operators import vectors as V
from ..registry import query
from ..session import AS_OF, Settings
from ..sources.tables import as_of, embeddings, events, pages, table, url_raw
from ..streaming import windows
from .scoring import final_scores
from .web import SQL_PAGES

_NOW = f"TIMESTAMP '{AS_OF}'"

# --- vectors ---

_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_EMB = """q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0),
s AS (SELECT 'doc/' || label AS url, CASE WHEN label % 2 = 0 THEN 'html' ELSE 'pdf' END AS doc_type, vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], b) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(b, b))), 6) AS similarity FROM embeddings, q)"""


def _first_vector(spark, sf_dir) -> list[float]:
    """The query's vector comes from outside, as one row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").head()[0]]


@query(f"WITH {_EMB} SELECT chunk_id, similarity, CASE WHEN similarity >= 0.9 THEN 'Excellent' WHEN similarity >= 0.8 THEN 'Very Good' WHEN similarity >= 0.7 THEN 'Good' ELSE 'Fair' END AS band FROM s")
def vector_cosine(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("chunk_id", F.round(V.cosine(F.col("embedding"), F.lit(_first_vector(spark, sf_dir))), 6).alias("similarity"))
    return e.withColumn("band", V.band(F.col("similarity")))


@query(f"WITH {_EMB} SELECT url, doc_type, chunk_id, similarity FROM s WHERE doc_type = 'html' AND similarity >= 0.1 ORDER BY similarity DESC, chunk_id LIMIT 20")
def semantic_topk(spark, sf_dir):
    return V.search(embeddings(spark, sf_dir), _first_vector(spark, sf_dir), 20, 0.1, "html")


@query(
    f"""WITH {_EMB}, t AS (SELECT * FROM s ORDER BY similarity DESC, chunk_id LIMIT 60)
    SELECT url, list(chunk_id ORDER BY similarity DESC, chunk_id) AS chunk_ids, list(similarity ORDER BY similarity DESC, chunk_id) AS scores, count(*) AS n_hits FROM t GROUP BY url"""
)
def semantic_by_doc(spark, sf_dir):
    return V.group_hits(V.search(embeddings(spark, sf_dir), _first_vector(spark, sf_dir), 60))


@query("SELECT count(*) AS n_chunks, count(DISTINCT label) AS n_documents, count(*) FILTER (WHERE label % 2 = 0) AS html_chunks, count(*) FILTER (WHERE label % 2 = 1) AS pdf_chunks FROM embeddings")
def embedding_stats(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("url").alias("n_documents"), F.count_if(F.col("doc_type") == "html").alias("html_chunks"), F.count_if(F.col("doc_type") == "pdf").alias("pdf_chunks"))


# --- searches: first user turns ask, pages answer ---

_SEARCH = """searches AS (SELECT conv_id AS query_id, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS query, TIMESTAMP '2024-01-31 00:00:00' + INTERVAL (conv_id % 48) HOUR AS at FROM conversations WHERE turn = 0),
results AS (SELECT s.query_id, p.page_id, (p.page_id // 50) + 1 AS position FROM searches s JOIN pages p ON p.page_id % 50 = s.query_id % 50 WHERE s.query_id % 3 <> 0)"""


def searches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    at = F.timestamp_micros(F.lit(1706659200000000) + F.col("conv_id") % 48 * F.lit(3600000000))
    return c.select(F.col("conv_id").alias("query_id"), T.normalize_query(F.col("text")).alias("query"), at.alias("at"))


def results(spark, sf_dir):
    """Positions of pages in searches; every third search has none."""
    s = searches(spark, sf_dir).filter("query_id % 3 <> 0").select("query_id", (F.col("query_id") % 50).alias("k"))
    p = pages(spark, sf_dir).select("page_id", "url", (F.col("page_id") % 50).alias("k"), (F.floor(F.col("page_id") / 50) + 1).alias("position"))
    return s.join(p, "k").drop("k")


@query(f"WITH {_SEARCH} SELECT s.query_id, s.query, s.at, count(r.page_id) AS n_results FROM searches s LEFT JOIN results r ON r.query_id = s.query_id GROUP BY ALL ORDER BY s.at DESC, s.query_id LIMIT 50")
def recent_searches(spark, sf_dir):
    n = results(spark, sf_dir).groupBy("query_id").agg(F.count("page_id").alias("n_results"))
    s = searches(spark, sf_dir).orderBy(F.col("at").desc(), "query_id").limit(50)
    return s.join(n, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


@query(f"WITH {_SEARCH}, {SQL_PAGES} SELECT r.query_id, r.position, p.norm AS url FROM results r JOIN p ON p.page_id = r.page_id")
def search_results_by_position(spark, sf_dir):
    return results(spark, sf_dir).select("query_id", "position", U.normalize_url(F.col("url")).alias("url"))


@query(
    f"""WITH {_SEARCH}, a AS (SELECT conv_id AS id, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS query FROM conversations WHERE turn = 0)
    SELECT id, max(query_id) AS query_id FROM (SELECT a.id, s.query_id, row_number() OVER (PARTITION BY a.id ORDER BY s.at DESC, s.query_id DESC) AS r FROM a JOIN searches s ON s.query = a.query AND epoch({_NOW}) - epoch(s.at) <= 24 * 3600) WHERE r = 1 GROUP BY id"""
)
def cache_exact_hit(spark, sf_dir):
    s = searches(spark, sf_dir).withColumn("settings", F.lit("{}"))
    return C.cached_search(s.select(F.col("query_id").alias("id"), "query", "settings"), s, as_of(), F.lit(24))


# --- pages in the cache ---


@query(
    f"""WITH {SQL_PAGES} SELECT list_sort(list(DISTINCT netloc))[1] AS host, count(*) AS n_fetches, count(DISTINCT norm) AS n_urls, min(page_id) AS first_page FROM p GROUP BY netloc"""
)
def url_cache_stats(spark, sf_dir):
    r = url_raw(spark, sf_dir)
    return r.groupBy(U.authority(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_fetches"), F.count_distinct("url").alias("n_urls"), F.min("raw_id").alias("first_page"))


@query(f"WITH {SQL_PAGES} SELECT norm AS url, max(page_id) AS raw_id, TIMESTAMP '2024-01-01' + INTERVAL (max(page_id)) HOUR AS fetched_at FROM p GROUP BY norm")
def latest_processed(spark, sf_dir):
    """The newest fetch of each URL."""
    return C.latest(url_raw(spark, sf_dir).drop("html"), "url", "fetched_at", "raw_id").select("url", "raw_id", "fetched_at")


@query(f"WITH {SQL_PAGES} SELECT norm AS url, min(TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR) AS first_seen, max(TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR) AS last_seen FROM p GROUP BY norm")
def url_upsert(spark, sf_dir):
    """Old pages and a later batch, merged."""
    r = url_raw(spark, sf_dir)
    old = r.filter("raw_id % 2 = 0").select("url", F.col("fetched_at").alias("first_seen"), F.col("fetched_at").alias("last_seen"))
    return C.upsert_urls(old, r.filter("raw_id % 2 <> 0").select("url", F.col("fetched_at").alias("at")))


@query(
    f"""WITH {_SEARCH}, b AS (SELECT query_id % 7 AS query_id, page_id, position, query_id AS seq, CASE WHEN query_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine FROM results)
    SELECT query_id, page_id AS url, max_by(position, seq) AS position, min_by(engine, seq) AS engine, count(*) AS n_seen FROM b GROUP BY query_id, page_id"""
)
def results_upsert(spark, sf_dir):
    r = results(spark, sf_dir)
    rows = r.select((F.col("query_id") % 7).alias("query_id"), F.col("page_id").alias("url"), "position", F.lit("").alias("title"), F.when(F.col("query_id") % 2 == 0, "a").otherwise("b").alias("engine"), F.col("query_id").alias("seq"))
    return C.upsert_results(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 <> 0")).drop("title")


@query("SELECT 'doc/' || user_id AS url, min(CASE WHEN event_type = 'view' THEN ts END) AS published_at, max(CASE WHEN event_type = 'click' THEN ts END) AS updated_at FROM events GROUP BY user_id")
def url_dates_merge(spark, sf_dir):
    e = events(spark, sf_dir)
    d = e.select("url", F.when(F.col("event") == "start", F.col("at")).alias("published_at"), F.when(F.col("event") == "touch", F.col("at")).alias("updated_at"), "event_id")
    return C.merge_dates(d.filter("event_id % 2 = 0").drop("event_id"), d.filter("event_id % 2 <> 0").drop("event_id"))


_AGE = f"(epoch_us({_NOW}) - epoch_us(ts)) / 86400000000.0::DOUBLE"


@query(
    f"""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'refetch' WHEN user_id % 4 = 1 AND event_id % 2 = 0 THEN 'refetch' WHEN event_id % 3 = 0 AND event_type <> 'view' THEN 'reuse-analysis' ELSE 'reprocess-same-raw' END AS decision FROM events"""
)
def reuse_decision(spark, sf_dir):
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    last = F.when(u % 4 != 0, F.lit("h"))
    new = F.when((u % 4 == 1) & (i % 2 == 0), "changed").when(u % 4 == 2, "h")
    return e.select("event_id", C.reuse_decision(last, new, F.when(i % 3 == 0, "h").otherwise("older"), F.col("event_type") != "view").alias("decision"))


@query(
    f"""SELECT event_id, CASE WHEN event_type = 'error' AND {_AGE} < 15 THEN 'skip-error' WHEN event_type = 'view' AND {_AGE} < 15 THEN 'skip-filtered' ELSE 'process' END AS decision,
    CASE WHEN event_type = 'purchase' AND {_AGE} < 7 THEN 'reuse' ELSE 'refetch' END AS reuse FROM events"""
)
def skip_decision(spark, sf_dir):
    status = F.when(F.col("event") == "fail", "error").when(F.col("event") == "start", "filtered").when(F.col("event") == "complete", "success")
    return events(spark, sf_dir).select("event_id", C.skip_decision(status, F.col("at"), as_of()).alias("decision"), C.simple_reuse(status, F.col("at"), as_of()).alias("reuse"))


@query(
    f"""WITH e AS (SELECT *, {_AGE} AS age, CASE WHEN user_id % 2 = 0 THEN 7 ELSE 30 END AS days FROM events)
    SELECT event_id, event_type = 'signup' OR (event_type NOT IN ('view') AND age < days) AS is_fresh,
    CASE WHEN event_type = 'signup' THEN 'not_modified' WHEN event_type = 'view' THEN 'content_updated' WHEN age < days THEN 'within_staleness' ELSE 'stale' END AS reason FROM e"""
)
def freshness_decision(spark, sf_dir):
    none, kind = F.lit(None).cast("string"), F.when(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint") % 2 == 0, "html").otherwise("pdf")
    status = F.when(F.col("event") == "enqueue", 304).otherwise(200)
    updated = F.when(F.col("event") == "start", F.col("at") + F.expr("INTERVAL 1 HOUR"))
    f = D.freshness(status, none, none, none, none, F.col("at"), updated, F.lit(None).cast("timestamp"), kind, Settings().staleness_days, as_of())
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", "f.is_fresh", "f.reason")


@query("SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-02 00:00:00' THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-08 00:00:00' END AS revalidate_after FROM events")
def revalidation(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", D.revalidate_after(F.col("at"), as_of()).alias("revalidate_after"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("pages", "documents", "events", "embeddings", "conversations")))
def table_counts(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    out = one("pages")
    for t in ("documents", "events", "embeddings", "conversations"):
        out = out.unionByName(one(t))
    return out


@query(
    """SELECT event_id AS key, CASE WHEN event_type = 'view' THEN regexp_extract(props, '(\\d+)', 1)::BIGINT END AS int_value, CASE WHEN event_type = 'click' THEN value END AS float_value,
    CASE WHEN event_type = 'error' THEN user_id % 2 = 0 END AS bool_value, CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN props END AS string_value FROM events"""
)
def settings_typed(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_type")
    value = F.when(k == "view", F.get_json_object("props", "$.k")).when(k == "click", F.col("value").cast("string")).when(k == "error", F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("no")).otherwise(F.col("props"))
    kind = F.when(k == "view", "int").when(k == "click", "float").when(k == "error", "bool").when(k == "signup", "json").otherwise("string")
    return C.typed_settings(e.select(F.col("event_id").alias("key"), value.alias("value"), kind.alias("type")))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def settings_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- downloads: orders are attempts, nations domains ---

_DL = """dl AS (SELECT o_orderkey AS id, n_name AS domain, CASE WHEN o_orderkey % 2 = 0 THEN 'direct' ELSE 'browser' END AS method, o_orderstatus = 'F' AS ok, CAST(trunc(o_totalprice) AS BIGINT) AS ms, o_orderdate AS "at", n_nationkey AS k
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def downloads(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    method = F.when(F.col("o_orderkey") % 2 == 0, "direct").otherwise("browser")
    return j.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("domain"), method.alias("method"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_totalprice").cast("bigint").alias("ms"), F.col("o_orderdate").alias("at"), F.col("n_nationkey").alias("k"))


@query(
    f"""WITH {_DL} SELECT domain, method, count(*) AS attempts, count(*) FILTER (WHERE ok) AS successes, round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 2) AS success_rate, (sum(ms) // count(*))::BIGINT AS average_ms FROM dl GROUP BY ALL"""
)
def domain_performance(spark, sf_dir):
    """Success rates and the running average of whole milliseconds by domain and method."""
    ok = F.count_if(F.col("ok"))
    return downloads(spark, sf_dir).groupBy("domain", "method").agg(
        F.count(F.lit(1)).alias("attempts"), ok.alias("successes"), F.round(F.lit(100.0) * ok / F.count(F.lit(1)), 2).alias("success_rate"), F.expr("sum(ms) div count(1)").alias("average_ms"),
    )


@query(
    f"""WITH {_DL}, p AS (SELECT domain, min(CASE WHEN NOT ok THEN "at" END) + INTERVAL 365 DAY AS switched_at FROM dl GROUP BY domain)
    SELECT p.domain, p.switched_at, count(d.id) AS later, count(*) FILTER (WHERE d.ok) AS later_ok FROM p LEFT JOIN dl d ON d.domain = p.domain AND d."at" > p.switched_at GROUP BY ALL"""
)
def auto_switch_analysis(spark, sf_dir):
    """What became of each domain after its switch: the time stands in the join's condition, so that domains without later downloads stay."""
    d = downloads(spark, sf_dir)
    p = d.groupBy("domain").agg((F.min(F.when(~F.col("ok"), F.col("at"))) + F.expr("INTERVAL 365 DAYS")).alias("switched_at"))
    j = p.alias("p").join(d.alias("d"), (F.col("p.domain") == F.col("d.domain")) & (F.col("d.at") > F.col("p.switched_at")), "left")
    return j.groupBy("p.domain", "p.switched_at").agg(F.count("d.id").alias("later"), F.count_if("d.ok").alias("later_ok"))


@query(f"WITH {_DL} SELECT count(DISTINCT domain) AS domains, count(*) FILTER (WHERE method = 'browser') AS browser, round(avg(ms), 2) AS mean_ms, min(ms) AS least_ms, max(ms) AS most_ms FROM dl")
def browser_pool_stats(spark, sf_dir):
    return downloads(spark, sf_dir).agg(F.count_distinct("domain").alias("domains"), F.count_if(F.col("method") == "browser").alias("browser"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"))


@query(
    f"""WITH {_DL} SELECT domain, r_name AS region, count(*) AS n, round(sum(ms) / 1048576.0::DOUBLE, 4) AS megabytes, count(*) FILTER (WHERE ok) AS ok FROM dl JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""
)
def pdf_stats(spark, sf_dir):
    d = downloads(spark, sf_dir).groupBy("domain", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms") / F.lit(1048576.0), 4).alias("megabytes"), F.count_if("ok").alias("ok"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return d.join(n, d["k"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("domain", F.col("r_name").alias("region"), "n", "megabytes", "ok")


_FOLD = """o AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS ok, max(event_id) AS last, arg_max(event_type, event_id) AS last_type, max(ts) AS "at" FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
fold AS (SELECT 'doc/' || o.user_id AS url, CASE WHEN last_type = 'purchase' THEN 'success' ELSE 'failed' END AS state, count(e.event_id) AS failures, o."at" FROM o LEFT JOIN events e ON e.user_id = o.user_id AND e.event_type = 'error' AND (o.ok IS NULL OR e.event_id > o.ok) GROUP BY ALL)"""


@query(f'WITH {_FOLD} SELECT url, state, failures, "at" FROM fold')
def pdf_state_fold(spark, sf_dir):
    return C.fold_attempts(events(spark, sf_dir), "complete", "fail")


@query(
    f"""WITH {_FOLD} SELECT url, CASE WHEN state = 'failed' AND failures < 3 THEN 'download:retry' WHEN state = 'failed' THEN 'skip:too-many-failures' WHEN "at" + INTERVAL 3 DAY < {_NOW} THEN 'download:stale' ELSE 'skip:fresh' END AS decision FROM fold"""
)
def pdf_decision(spark, sf_dir):
    f = C.fold_attempts(events(spark, sf_dir), "complete", "fail")
    processing = F.when(F.col("state") == "success", "success").otherwise("pending")
    return f.select("url", C.pdf_decision(F.col("state"), processing, F.lit("fresh"), F.col("failures"), F.lit(0), F.col("at") + F.expr("INTERVAL 3 DAYS"), as_of()).alias("decision"))


# --- the queue ---

_QUEUE = """f AS (SELECT user_id, min(event_id) AS added, min(ts) AS added_at FROM events WHERE event_type = 'signup' GROUP BY user_id),
l AS (SELECT e.user_id, arg_max(event_type, event_id) AS last, max(ts) AS moved FROM events e JOIN f ON f.user_id = e.user_id AND e.event_id > f.added WHERE event_type IN ('view', 'purchase', 'error') GROUP BY e.user_id),
r AS (SELECT e.user_id, count(*) AS n FROM events e JOIN f ON f.user_id = e.user_id AND e.event_id > f.added WHERE event_type = 'error' GROUP BY e.user_id),
state AS (SELECT 'doc/' || f.user_id AS url, CASE WHEN last = 'view' THEN 'processing' WHEN last = 'purchase' THEN 'completed' WHEN last = 'error' AND coalesce(n, 0) >= 30 THEN 'failed' ELSE 'pending' END AS status, coalesce(n, 0) AS retry_count, f.added_at, coalesce(moved, f.added_at) AS updated_at
  FROM f LEFT JOIN l ON l.user_id = f.user_id LEFT JOIN r ON r.user_id = f.user_id)"""
#: Users have many events here, so that the limit is higher than an application's.
_RETRIES = 30


@query(f"WITH {_QUEUE} SELECT * FROM state")
def queue_state(spark, sf_dir):
    return Q.queue_state(events(spark, sf_dir), _RETRIES)


@query(f"WITH {_QUEUE} SELECT s.status, count(state.url) AS n FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed')) s(status) LEFT JOIN state ON state.status = s.status GROUP BY s.status")
def queue_stats(spark, sf_dir):
    return Q.queue_stats(Q.queue_state(events(spark, sf_dir), _RETRIES))


@query(f"WITH {_QUEUE} SELECT * FROM state WHERE status = 'pending' AND retry_count < 30 ORDER BY added_at, url LIMIT 10")
def queue_next(spark, sf_dir):
    return Q.next_pending(Q.queue_state(events(spark, sf_dir), _RETRIES), 10, _RETRIES)


@query(f"WITH {_QUEUE} SELECT url, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, retry_count, added_at, updated_at FROM state WHERE NOT (status = 'completed' AND (epoch_us({_NOW}) - epoch_us(updated_at)) / 86400000000.0 > 3)")
def queue_cleanup(spark, sf_dir):
    """Old completed items gone, stuck ones reset."""
    return Q.reset_stuck(Q.clear_completed(Q.queue_state(events(spark, sf_dir), _RETRIES), as_of(), 3))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'cache' WHEN event_type IN ('view', 'signup') AND user_id % 2 = 0 THEN 'queued' WHEN event_type = 'error' THEN 'failed' WHEN value > 10 THEN 'background' ELSE 'fast' END AS lane FROM events")
def lane_router(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_type")
    status = F.when(k.isin("view", "signup") & (F.col("user_id") % 2 == 0), "pending").when(k == "error", "failed")
    return e.select("event_id", Q.lane(k == "purchase", status, F.col("value"), F.lit(1)).alias("lane"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    """The batch face of streaming.windows.tumbling."""
    t = windows.tumbling(events(spark, sf_dir), "1 day")
    kinds = F.create_map(*[F.lit(x) for x in ("enqueue", "signup", "start", "view", "complete", "purchase", "fail", "error", "touch", "click")])
    return t.select(F.col("window.start").alias("day"), F.element_at(kinds, F.col("event")).alias("event_type"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT 'doc/' || user_id AS url, min(ts) AS begin_at, max(ts) + INTERVAL 4 HOUR AS end_at, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def events_session(spark, sf_dir):
    """The batch face of streaming.windows.sessions."""
    s = windows.sessions(events(spark, sf_dir), "4 hours")
    return s.select("url", F.col("session.start").alias("begin_at"), F.col("session.end").alias("end_at"), "n")


@query(f"""WITH {SQL_PAGES}, h AS (SELECT netloc, count(*) AS n FROM p GROUP BY netloc) SELECT netloc AS host, n FROM h WHERE netloc NOT IN (SELECT netloc FROM p WHERE page_id % 5 = 0)""")
def hosts_not_seen(spark, sf_dir):
    """Set difference as an anti-join: hosts without a page among every fifth."""
    p = pages(spark, sf_dir).select("page_id", F.lower(U.authority(F.col("url"))).alias("host"))
    seen = p.filter("page_id % 5 = 0").select("host").distinct()
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(seen, "host", "left_anti")


@query()
def analysis_pipeline(spark, sf_dir):
    """URL to scored document: canonical URL, decision by the newest fetch, lane, score, class, and the merged store row."""
    f = final_scores(spark, sf_dir).select("page_id", "url", "n_words", "score", "class", "status")
    one = f.groupBy("url").agg(F.max_by(F.struct("page_id", "n_words", "score", "class", "status"), "page_id").alias("r")).select("url", "r.*")
    # fetches end some days before now
    at = url_raw(spark, sf_dir).groupBy("url").agg((F.max("fetched_at") + F.expr("INTERVAL 24 DAYS")).alias("processed_at"))
    j = one.join(at, "url").withColumn("lane", U.url_lane(F.col("url")))
    return j.withColumn("decision", C.simple_reuse(F.col("status"), F.col("processed_at"), as_of())).withColumn("relabelled", S.class_of(F.col("score"), "junk"))
