"""What is written to the cache and the stores, page structure with boxes, and chunks of PDF blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import cache as C
from ..operators import chunking as K
from ..operators import layout as L
from ..operators import queue as Q
from ..operators import vectors as V
from ..registry import query
from ..session import AS_OF, Settings
from ..sources.tables import as_of, embeddings, events, pages, pdf_spans, table, url_raw
from .layout import _SPANS
from .scoring import _BODIES, _MARKED, marked_pages
from .store import _QUEUE, _RETRIES
from .web import _QUERY_SQL, _WORDS, SQL_PAGES, sql_alike

_NOW = f"TIMESTAMP '{AS_OF}'"
_HASH = r"""sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
  '(?s)<!--.*?-->', '', 'g'), '(?is)<div[^>]*class=["''][^"'']*\b(?:ad|advertisement|advert|sponsored)\b[^"'']*["''][^>]*>.*?</div>', '', 'g'), '\s+', ' ', 'g')))"""


# --- searches ---


@query(
    f"""SELECT conv_id AS query_id, {_QUERY_SQL} AS query, '{{"kind":"' || CASE WHEN conv_id % 2 = 0 THEN 'news' ELSE 'web' END || '","pages":"' || conv_id % 3 || '"}}' AS settings, {_NOW} AS at
    FROM conversations WHERE role = 'user' AND turn = 0"""
)
def search_started(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user' AND turn = 0")
    settings = F.create_map(F.lit("pages"), (F.col("conv_id") % 3).cast("string"), F.lit("kind"), F.when(F.col("conv_id") % 2 == 0, "news").otherwise("web"))
    return C.start_searches(c.select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"), settings.alias("settings")), as_of())


@query("SELECT conv_id AS query_id, CASE WHEN conv_id % 3 = 0 THEN 'about ' || conv_id WHEN conv_id % 2 = 0 THEN 'old' END AS analysis, CASE WHEN conv_id % 3 = 0 THEN conv_id % 5 ELSE 0 END AS n_analysed FROM conversations WHERE turn = 0")
def search_analysed(spark, sf_dir):
    """Analyses of every third search saved."""
    i = F.col("query_id")
    s = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"))
    old = s.withColumn("analysis", F.when(i % 2 == 0, "old")).withColumn("n_analysed", F.lit(0).cast("bigint"))
    return C.save_analyses(old, s.filter("query_id % 3 = 0").select("query_id", F.concat(F.lit("about "), i).alias("analysis"), (i % 5).alias("n_analysed")))


@query(
    rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, {_QUERY_SQL} AS text FROM conversations WHERE role = 'user'),
    searches AS (SELECT conv_id AS query_id, text AS query, TIMESTAMP '2024-01-31' + INTERVAL (conv_id % 48) HOUR AS made FROM c WHERE turn = 0),
    asks AS (SELECT conv_id || '/' || turn AS id, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(text, '\s\S+$', '') ELSE text END AS query FROM c),
    fresh AS (SELECT * FROM searches WHERE TIMESTAMP '{AS_OF}' - made <= INTERVAL 24 HOUR),
    exact AS (SELECT id, arg_max(query_id, (made, query_id)) AS query_id, 100 AS score FROM asks JOIN fresh USING (query) GROUP BY id),
    asked AS (SELECT * FROM asks WHERE id NOT IN (SELECT id FROM exact)), cached AS (SELECT query FROM fresh), {sql_alike(90)},
    owner AS (SELECT query AS match, min(query_id) AS query_id FROM fresh GROUP BY 1), best AS (SELECT query, query_id, ratio, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, query_id) AS r FROM alike JOIN owner USING (match))
    SELECT * FROM exact UNION ALL SELECT id, query_id, floor(ratio)::INT AS score FROM asked JOIN best USING (query) WHERE r = 1"""
)
def search_looked_up(spark, sf_dir):
    """User turns against the first turns' searches: exact hits of a day, else fuzzy ones. Every other conversation asks one word less."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "turn", T.normalize_query(F.col("text")).alias("query"), F.lit("{}").alias("settings"))
    at = F.timestamp_micros(F.lit(1706659200000000) + F.col("conv_id") % 48 * F.lit(3600000000))
    cached = c.filter("turn = 0").select(F.col("conv_id").alias("query_id"), "query", "settings", at.alias("at"))
    asked = c.select("id", F.when(F.col("conv_id") % 2 == 0, F.regexp_replace("query", r"\s\S+$", "")).otherwise(F.col("query")).alias("query"), "settings")
    return C.look_up(asked, cached, as_of(), F.lit(24), 90)


# --- fetches, analyses ---


@query(f"WITH {SQL_PAGES} SELECT norm AS url, {_HASH} AS content_hash, TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR AS fetched_at, strlen(html) AS n_bytes FROM p")
def fetches_recorded(spark, sf_dir):
    r = url_raw(spark, sf_dir)
    none = C.record_fetches(spark.createDataFrame([], "url string, content_hash string, fetched_at timestamp, n_bytes int"), r.filter("raw_id % 2 = 0"))
    return C.record_fetches(none, r.filter("raw_id % 2 <> 0"))


@query(
    f"""WITH {SQL_PAGES}, f AS (SELECT norm AS url, page_id, {_HASH} AS content_hash FROM p), n AS (SELECT url, arg_max(content_hash, page_id) AS content_hash FROM f GROUP BY url),
    a AS (SELECT url, content_hash, page_id AS analysis_id, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE 'new' END AS pipeline FROM f)
    SELECT a.url, a.content_hash, max(analysis_id) AS analysis_id FROM a JOIN n ON n.url = a.url AND n.content_hash = a.content_hash WHERE pipeline = 'new' GROUP BY ALL"""
)
def analyses_cached(spark, sf_dir):
    """Newest analyses of the newest content by the current version."""
    r = url_raw(spark, sf_dir)
    f = r.select("raw_id", "url", T.html_content_hash(F.col("html")).alias("content_hash"), "fetched_at")
    a = f.select("url", "content_hash", F.col("fetched_at").alias("created_at"), F.col("raw_id").alias("analysis_id"), F.when(F.col("raw_id") % 4 == 0, "old").otherwise("new").alias("pipeline"))
    return C.cached_analyses(f, a, {"pipeline": "new"})


@query(
    f"""WITH {SQL_PAGES}, r AS (SELECT norm AS url, page_id, CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'filtered' WHEN 2 THEN 'error' ELSE 'failed' END AS status, {_NOW} - INTERVAL (page_id % 30) DAY AS processed_at FROM p),
    l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY processed_at DESC, page_id DESC) AS k FROM r), d AS (SELECT *, CASE WHEN processed_at = {_NOW} THEN 999 ELSE date_diff('day', processed_at, {_NOW}) END AS age FROM l WHERE k = 1)
    SELECT url, status, processed_at, CASE WHEN status IN ('error', 'failed') AND age < 15 THEN 'skip-error' WHEN status = 'filtered' AND age < 15 THEN 'skip-filtered' ELSE 'process' END AS decision FROM d"""
)
def latest_decision(spark, sf_dir):
    """Each URL's latest row, and whether it is skipped."""
    i = F.col("raw_id")
    r = url_raw(spark, sf_dir).select("url", "raw_id")
    status = F.element_at(F.array(*map(F.lit, ("success", "filtered", "error", "failed"))), (i % 4 + 1).cast("int"))
    done = r.select("url", status.alias("status"), (as_of() - F.make_dt_interval((i % 30).cast("int"))).alias("processed_at"), i.alias("proc_id"))
    return C.latest_decisions(r.select("url").distinct(), done, as_of())


_SCORES = """CASE doc_id % 5 WHEN 0 THEN '{"final_score":' || doc_id % 100 || ',"heuristic_score":55,"word_count":7}' WHEN 1 THEN '{"quality_class":"legit","nlp_score":40}' WHEN 2 THEN '{"final_score":45}' WHEN 3 THEN NULL ELSE '{"final_score":90,"quality_class":""}' END"""


@query(
    f"""WITH q AS (SELECT doc_id, text, {_SCORES} AS j FROM documents),
    s AS (SELECT doc_id, coalesce(json_extract_string(j, '$.heuristic_score')::INT, 0) AS heuristic_score, coalesce(json_extract_string(j, '$.nlp_score')::INT, 0) AS nlp_score, coalesce(json_extract_string(j, '$.final_score')::INT, 0) AS final_score,
      coalesce(json_extract_string(j, '$.word_count')::INT, 0) AS n, nullif(json_extract_string(j, '$.quality_class'), '') AS c, len({_WORDS.format(t='text')}) AS w FROM q)
    SELECT doc_id AS proc_id, heuristic_score, nlp_score, final_score, CASE WHEN n = 0 THEN w ELSE n END AS word_count, coalesce(c, CASE WHEN final_score >= 70 THEN 'legit' WHEN final_score >= 40 THEN 'maybe' ELSE 'skip' END) AS quality_class FROM s"""
)
def quality_scores_read(spark, sf_dir):
    """Stored scores with fields that are missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("proc_id"), F.expr(_SCORES).alias("scores"), F.col("text").alias("content"))
    return C.quality_scores(d)


@query("SELECT page_id AS index, page_id % 3 = 0 AS cached, CASE WHEN page_id % 3 = 0 THEN 0 ELSE length(html) END AS n_chars FROM pages ORDER BY page_id")
def results_in_order(spark, sf_dir):
    """Cached and processed results in the order of the question, without heavy columns."""
    p = pages(spark, sf_dir).withColumn("index", F.col("page_id"))
    cached = p.filter("page_id % 3 = 0").select("index", F.lit(True).alias("cached"), F.col("html").alias("document"))
    done = p.filter("page_id % 3 <> 0").select("index", F.lit(False).alias("cached"), F.length("html").alias("n_chars"), F.col("html").alias("full_extraction"))
    return C.merge_by_index(cached, done).withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 304 ELSE 200 END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 2 END AS old_tag, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 2 END AS new_tag,
      CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 4 END AS old_mod, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS new_mod, CASE WHEN o_custkey % 11 <> 0 THEN o_orderkey % 60 END AS fetched, CASE WHEN o_orderkey % 5 = 1 THEN o_custkey % 100 END AS updated,
      CASE WHEN o_totalprice > 100000 THEN epoch_us({_NOW}) - epoch_us(o_orderdate::TIMESTAMP) WHEN o_totalprice > 40000 THEN (o_custkey % 500) * 86400000000 END / 86400000000.0::DOUBLE AS published, CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 90 ELSE 30 END AS days FROM orders),
    r AS (SELECT k, CASE WHEN status = 304 THEN 'not_modified' WHEN old_tag = new_tag THEN 'etag_match' WHEN old_tag IS NOT NULL AND new_tag IS NOT NULL THEN 'etag_changed' WHEN old_mod = new_mod THEN 'last_modified_match' WHEN updated < fetched THEN 'content_updated'
      WHEN fetched IS NULL THEN 'never_fetched' WHEN fetched < days THEN 'within_staleness' WHEN published IS NOT NULL AND coalesce(updated, published) > 365 THEN 'old_content' ELSE 'stale' END AS reason FROM o)
    SELECT k AS o_orderkey, reason IN ('not_modified', 'etag_match', 'last_modified_match', 'within_staleness', 'old_content') AS is_fresh, reason FROM r"""
)
def freshness_branches(spark, sf_dir):
    """Every branch of the decision on freshness, by orders' own columns: tags, dates and ages follow from keys, prices, states and order dates."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    ago = lambda days: as_of() - F.make_dt_interval(days.cast("int"))
    text = lambda ok, x: F.when(ok, x.cast("string"))
    published = F.when(price > 100000, F.col("o_orderdate").cast("timestamp")).when(price > 40000, ago(c % 500))
    kind = F.when(k % 3 == 0, "news").when(k % 3 == 1, "paper").otherwise("docs")
    d = D.freshness(
        F.when(F.col("o_orderstatus") == "P", 304).otherwise(200), text(c % 3 == 0, c % 2), text(k % 4 == 0, k % 2), text(c % 5 == 0, c % 4), text(k % 3 == 0, k % 4),
        F.when(c % 11 != 0, ago(k % 60)), F.when(k % 5 == 1, ago(c % 100)), published, kind, Settings().staleness_days, as_of(),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.*")


@query(
    """WITH e AS (SELECT event_id, event_id % 8 AS k, ts, date_trunc('day', ts) AS d, date_trunc('day', ts) + INTERVAL 3 DAY AS l FROM events)
    SELECT event_id, CASE WHEN k IN (0, 1, 3, 4, 5) THEN d WHEN k = 2 THEN d + INTERVAL 10 HOUR END AS published, CASE WHEN k IN (0, 1) THEN 'jsonld' WHEN k IN (2, 3, 4) THEN 'og' WHEN k = 5 THEN 'byline' ELSE 'none' END AS published_source,
    CASE WHEN k IN (0, 1, 3, 5) THEN l WHEN k IN (2, 6) THEN ts WHEN k = 4 THEN l + INTERVAL 1 HOUR END AS updated, CASE k WHEN 0 THEN 'jsonld' WHEN 1 THEN 'og' WHEN 2 THEN 'http_last_modified' WHEN 3 THEN 'og' WHEN 4 THEN 'sitemap' WHEN 5 THEN 'byline' WHEN 6 THEN 'http_last_modified' ELSE 'none' END AS updated_source FROM e"""
)
def dates_detected(spark, sf_dir):
    """Dates of pages that have them in one of the places, by event: JSON-LD, its graph, meta tags either way round, time elements, bylines, and what a server or a sitemap says."""
    at, k = F.col("at"), F.col("k")
    e = events(spark, sf_dir).select("event_id", (F.col("event_id") % 8).alias("k"), "at", F.date_format("at", "yyyy-MM-dd").alias("d"), F.date_format(F.col("at") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd").alias("l"))
    text = lambda *parts: F.concat(*[F.col(x) if x in ("d", "l") else F.lit(x) for x in parts])
    html = (
        F.when(k == 0, text('<script type="application/ld+json">{"@type":"Article","datePublished":"', "d", '","dateModified":"', "l", '"}</script>'))
        .when(k == 1, text('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"datePublished":"', "d", '"}]}</script><meta property="article:modified_time" content="', "l", '">'))
        .when(k == 2, text('<meta property="article:published_time" content="', "d", 'T10:00:00Z">'))
        .when(k == 3, text('<meta content="', "d", '" name="datePublished"><meta itemprop="dateModified" content="', "l", '">'))
        .when(k == 4, text('<time itemprop="datePublished" datetime="', "d", '">long ago</time>'))
        .otherwise("<p>nothing here</p>")
    )
    day = lambda c: F.date_format(F.to_date(c), "MMMM d, yyyy")
    byline = F.when(k == 5, F.concat(F.lit("Published: "), day("d"), F.lit(", as it was written by those who were there. Updated: "), day("l"))).otherwise("no date")
    http, sitemap = F.when(k.isin(2, 6), at), F.when(k.isin(2, 4), F.to_timestamp("l") + F.expr("INTERVAL 1 HOUR"))
    # few bytes and much work: rows are dealt out evenly, and pages are made once, before their dates are looked for
    made = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("event_id", html.alias("html"), byline.alias("byline"), http.alias("http"), sitemap.alias("sitemap"))
    return made.select("event_id", D.detect_dates(*map(F.col, ("html", "byline", "http", "sitemap"))).alias("x")).select("event_id", "x.*")


_ITEMS = f"""flatten(list_transform({_BODIES}, lambda b: CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') ELSE [b::JSON] END))"""
_OG = """nullif(regexp_extract(html, '(?is)<meta[^>]*property=["'']og:article:author["''][^>]*content=["'']([^"'']*)["'']', 1), '')"""


@query(
    rf"""WITH {_MARKED}, i AS (SELECT page_id, html, {_ITEMS} AS items FROM marked), a AS (SELECT *, list_filter(items, lambda x: contains(coalesce(json_extract_string(x, '$."@type"'), ''), 'Article'))[-1] AS item, regexp_matches(html, '(?i)property=["'']og:') AS og FROM i)
    SELECT page_id, len(items) > 0 AS has_jsonld, og AS has_opengraph, regexp_matches(html, '(?i)\sitemscope') AS has_microdata, json_extract_string(item, '$."@type"') AS article_type, coalesce(json_extract_string(item, '$.author.name'), CASE WHEN og THEN {_OG} END) AS author,
      CASE WHEN og AND json_extract_string(item, '$.author.name') IS NULL THEN NULL ELSE json_extract_string(item, '$.datePublished') END AS date FROM a"""
)
def structured_data_marked(spark, sf_dir):
    """Structured data of pages that have some, in several scripts."""
    return marked_pages(spark, sf_dir).select("page_id", H.structured_data(F.col("html")).alias("s")).select("page_id", "s.*")


# --- embeddings, queue ---


def _stored(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("url", "chunk_id", (F.col("chunk_id") % 97).alias("created_at"))
    return e.filter("chunk_id % 2 = 0"), e.filter("chunk_id % 2 = 1 AND url IN ('doc/1', 'doc/4', 'doc/7')")


_STORE = """e AS (SELECT 'doc/' || label AS url, vec_id AS chunk_id, vec_id % 97 AS created_at, label FROM embeddings),
st AS (SELECT url, chunk_id, created_at FROM e WHERE (chunk_id % 2 = 0 AND label NOT IN (1, 4, 7)) OR (chunk_id % 2 = 1 AND label IN (1, 4, 7)))"""


@query(f"WITH {_STORE} SELECT * FROM st WHERE url <> 'doc/2'")
def embeddings_replaced(spark, sf_dir):
    """Three documents stored anew, one deleted."""
    return V.delete_documents(V.replace_chunks(*_stored(spark, sf_dir)), spark.createDataFrame([("doc/2",)], "url string"))


@query(f"WITH {_STORE} SELECT * FROM st ORDER BY created_at DESC, url, chunk_id LIMIT 100")
def embeddings_newest(spark, sf_dir):
    return V.newest(V.replace_chunks(*_stored(spark, sf_dir)), 100)


@query("WITH e AS (SELECT * FROM events WHERE event_type IN ('view', 'purchase', 'error')) SELECT 'doc/' || user_id AS url, CASE arg_max(event_type, ts) WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, max(ts) AS updated_at FROM e GROUP BY user_id HAVING status = 'failed'")
def embedding_retries(spark, sf_dir):
    """Documents whose last attempt failed: embedded again, others not."""
    e = events(spark, sf_dir).filter("event IN ('start', 'complete', 'fail')").withColumn("error", F.lit(None).cast("string"))
    s = V.embedding_states(spark.createDataFrame([], "url string, status string, updated_at timestamp, error string"), e)
    return V.to_embed(s.select("url", "status", "updated_at"), s)


@query(f"WITH {_QUEUE} SELECT url, updated_at FROM state WHERE status = 'completed' ORDER BY updated_at DESC, url LIMIT 10")
def queue_last_completed(spark, sf_dir):
    return Q.last_completed(Q.queue_state(events(spark, sf_dir), _RETRIES)).select("url", "updated_at")


# --- PDF blocks ---

_BLOCKS = f"""{_SPANS}, b AS (SELECT doc_id, page_no, span_no AS block_no, text, CASE WHEN starts_with(text, 'Report') THEN 'title' WHEN starts_with(text, 'Section') THEN 'h1' ELSE 'body' END AS type FROM spans)"""


def _blocks(spark, sf_dir):
    t = F.col("text")
    return pdf_spans(spark, sf_dir).select("doc_id", "page_no", F.col("span_no").alias("block_no"), "text", F.when(t.startswith("Report"), "title").when(t.startswith("Section"), "h1").otherwise("body").alias("type"))


@query(
    f"""WITH {_BLOCKS}, l AS (SELECT *, type <> 'body' AS head, lag(type) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) AS prev FROM b),
    isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR (head AND prev = 'body') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, block_no ROWS UNBOUNDED PRECEDING) AS island FROM l),
    c AS (SELECT doc_id, island, min(page_no) AS page_no, list(text ORDER BY page_no, block_no) FILTER (WHERE head) AS headings, coalesce(string_agg(text || chr(10), '' ORDER BY page_no, block_no) FILTER (WHERE NOT head), '') AS content FROM isl GROUP BY doc_id, island),
    g AS (SELECT *, coalesce(sum(CASE WHEN content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS chunk_no FROM c)
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, coalesce(max(CASE WHEN content <> '' THEN page_no END), max(page_no)) AS page_no, coalesce(array_to_string(flatten(list(coalesce(headings, []) ORDER BY island)), '|'), '') AS headings, max(content) AS content FROM g GROUP BY doc_id, chunk_no"""
)
def pdf_page_chunks(spark, sf_dir):
    """Headings with what follows them; headings alone go to the next chunk."""
    return K.page_chunks(_blocks(spark, sf_dir)).withColumn("headings", F.array_join("headings", "|"))


@query(
    f"""WITH {_BLOCKS}, l AS (SELECT *, type <> 'body' AS head, lag(type) OVER (PARTITION BY doc_id ORDER BY page_no, block_no) AS prev FROM b),
    isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR (head AND prev = 'body') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, block_no ROWS UNBOUNDED PRECEDING) AS section_id FROM l)
    SELECT doc_id, section_id::BIGINT AS section_id, coalesce(string_agg(text, '|' ORDER BY page_no, block_no) FILTER (WHERE head), '') AS headers, coalesce(string_agg(text, ' ' ORDER BY page_no, block_no) FILTER (WHERE NOT head), '') AS section_text, count(*) FILTER (WHERE NOT head) AS n_blocks FROM isl GROUP BY doc_id, section_id"""
)
def pdf_sections(spark, sf_dir):
    s = K.header_sections(_blocks(spark, sf_dir), ("title", "h1"), ("body",))
    return s.withColumn("headers", F.array_join("headers", "|"))


@query(
    """WITH RECURSIVE c AS (
      SELECT doc_id, text, 0 AS char_start, 0 AS char_end, 0 AS k FROM documents
      UNION ALL
      SELECT doc_id, text, char_end AS char_start, CASE WHEN char_end + 1000 >= length(text) THEN length(text) WHEN position(' ' IN reverse(substr(text, char_end + 2, 999))) > 0 THEN char_end + 1001 - position(' ' IN reverse(substr(text, char_end + 2, 999))) ELSE char_end + 1000 END AS char_end, k + 1
      FROM c WHERE char_end < length(text))
    SELECT doc_id, char_start, char_end, trim(substr(text, char_start + 1, char_end - char_start), E' \\n\\t\\r') AS chunk FROM c WHERE k > 0 AND trim(substr(text, char_start + 1, char_end - char_start), E' \\n\\t\\r') <> ''"""
)
def space_chunks(spark, sf_dir):
    """Chunks of at most 1,000 characters that end after a space."""
    return K.space_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {_BLOCKS} SELECT doc_id, page_no AS chunk_id, string_agg(text, ' ' ORDER BY block_no) AS text, len({_WORDS.format(t='''string_agg(text, ' ' ORDER BY block_no)''')}) AS n_words, length(string_agg(text, ' ' ORDER BY block_no)) AS n_chars FROM b GROUP BY doc_id, page_no")
def pdf_chunk_list(spark, sf_dir):
    """Nested content of sections, chunks and blocks as a list of chunks."""
    b = _blocks(spark, sf_dir)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: F.struct(x["text"].alias("text")))
    c = b.groupBy("doc_id", "page_no").agg(blocks.alias("blocks")).select("doc_id", F.struct(F.col("page_no").alias("chunk_id"), F.lit(None).cast("int").alias("char_count"), "blocks").alias("c"))
    nested = c.groupBy("doc_id", (F.col("c.chunk_id") % 2).alias("s")).agg(F.collect_list("c").alias("chunks")).groupBy("doc_id").agg(F.collect_list(F.struct("chunks")).alias("content"))
    return K.chunk_list(nested, "doc_id")


@query(f"WITH {_SPANS} SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY span_no) AS text, length(string_agg(text, ' ' ORDER BY span_no)) AS n_chars, count(*) AS n_spans FROM spans GROUP BY doc_id, page_no")
def pdf_page_texts(spark, sf_dir):
    return L.page_texts(pdf_spans(spark, sf_dir)).drop("n_words")


@query(
    f"""WITH {_SPANS}, b AS (SELECT doc_id, page_no, span_no AS block_no, trim(text) AS t, text, span_no % 97 * 8.0::DOUBLE AS y0, span_no % 97 * 8.0::DOUBLE + 12 AS y1, span_no % 5 <> 0 AS boxed FROM spans),
    h AS (SELECT doc_id, coalesce(arg_min(y1, (page_no, block_no)) FILTER (WHERE boxed AND page_no <= 3) + 50, 792) AS height, count(DISTINCT page_no) AS n_pages FROM b GROUP BY doc_id), s AS (SELECT doc_id, t, count(DISTINCT page_no) AS on_pages FROM b GROUP BY ALL)
    SELECT b.doc_id, page_no, block_no, text, (boxed AND (y0 <= height * 0.08::DOUBLE OR y1 >= height - height * 0.08::DOUBLE)) OR on_pages >= n_pages * 0.6::DOUBLE AS is_header_footer FROM b JOIN h ON h.doc_id = b.doc_id JOIN s ON s.doc_id = b.doc_id AND s.t = b.t"""
)
def pdf_header_footer(spark, sf_dir):
    """Headers and footers by margin and by recurrence."""
    y = F.col("span_no") % 97 * F.lit(8.0)
    box = F.when(F.col("span_no") % 5 != 0, F.array(F.lit(0.0), y, F.lit(600.0), y + 12))
    return L.header_footer(pdf_spans(spark, sf_dir).select("doc_id", "page_no", F.col("span_no").alias("block_no"), "text", box.alias("bbox")))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderkey % 7, o_orderkey % 3, 2, o_orderkey % 5, o_custkey % 7])), ',') AS pages FROM orders")
def page_unions(spark, sf_dir):
    """Page numbers of two chunks that are merged."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(K.page_union(F.array(k % 7, k % 3, F.lit(2).cast("bigint")), F.array(k % 5, F.col("o_custkey") % 7)).cast("array<string>"), ",").alias("pages"))
