"""WARC revisit records that stand for 'not modified' responses, resolved to what they refer to.

An as-of join: each revisit takes the latest earlier full response of the same
canonical URL, whose validators must agree with the revisit's (ETag by weak
comparison where both have one, else Last-Modified); then the response's
headers are merged with those that a 304 may update.

A URL may be captured any number of times. The records are range-partitioned
by URL and time and written; within a stored partition a window finds the
latest response of a URL, and what earlier partitions end with is carried in
through a table with a row for each URL and partition, so that a URL with a
third of all records is spread over as many tasks as it fills.

Records: record_id, url, captured_at (any order type), kind ('response' or
'revisit'), etag, last_modified, headers (map of lower-cased names).

Defined results: a revisit with no earlier response is `unresolved`; one with
a validator that differs is `mismatch`; one without a common validator is
`unverified`, and keeps its response; the rest are `resolved`. Records with a
null url or time stay unresolved. Of responses at the same time the one with
the largest record_id counts; a response at the revisit's own time isn't
earlier. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: Headers that a 304 response may carry to update the stored ones.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and host, no scheme's own port, `www.`, fragment, tracking parameters or trailing slash; parameters sorted."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    found = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", found).otherwise(whole)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _moment(t: Column, kind: str) -> Column:
    return F.unix_micros(t.cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else t.cast("bigint")


def _merged(stored: Column, new: Column) -> Column:
    """The stored headers, with those that a 304 may update taken from the new ones."""
    empty = F.expr("cast(map() as map<string,string>)")
    update = F.map_filter(F.coalesce(new, empty), lambda k, _: k.isin(*UPDATABLE))
    rest = F.map_filter(F.coalesce(stored, empty), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(rest, update)


def resolve(records: DataFrame) -> DataFrame:
    """For every revisit: record_id, canonical_url, status, response_id, response_at, headers."""
    r = pick(records, "record_id", "url", "captured_at", "kind", "etag", "last_modified", "headers")
    moment = _moment(F.col("captured_at"), r.schema["captured_at"].dataType.simpleString())
    r = r.withColumn("canon", canonical_url(F.col("url"))).withColumn("at", moment).filter(F.col("kind").isin("response", "revisit"))
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one URL and moment stay together; other rows of a URL may fill several partitions, in order
    stored = materialize(r.repartitionByRange(n, "canon", "at").withColumn("part", F.spark_partition_id()), "captures")
    key = F.struct("at", "record_id")
    response = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), F.struct("record_id", "captured_at", "etag", "last_modified", "headers"))
    rank = F.when(response.isNotNull(), key)
    earlier = Window.partitionBy("canon", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = stored.withColumn("here", F.max_by(response, rank).over(earlier))
    ends = stored.groupBy("canon", "part").agg(F.max_by(response, rank).alias("end"), F.max(rank).alias("rank"))
    before = Window.partitionBy("canon").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("canon").alias("c"), F.col("part").alias("p"), F.max_by("end", "rank").over(before).alias("carried"))
    found = here.filter("kind = 'revisit'").join(carried, (F.col("canon") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    found = found.withColumn("full", F.when(F.col("at").isNotNull() & F.col("canon").isNotNull(), F.coalesce("here", "carried")))
    tags = F.col("etag").isNotNull() & F.col("full.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("full.etag"))).when(dates, F.col("last_modified") == F.col("full.last_modified"))
    status = F.when(F.col("full").isNull(), "unresolved").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    good = F.col("status").isin("resolved", "unverified")
    found = found.withColumn("status", status)
    return found.select(
        "record_id", F.col("canon").alias("canonical_url"), "status",
        F.when(good, F.col("full.record_id")).alias("response_id"), F.when(good, F.col("full.captured_at")).alias("response_at"),
        F.when(good, _merged(F.col("full.headers"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl: of each page its response, and a revisit that another fetch of the page got.

    The revisits have every kind of validator: the page's ETag, its weak form, an outdated one, only a date, none; some come before the response.
    """
    p = pick(pages, "page_id", "url", "html")
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    text = lambda c: c.cast("string")
    i = F.col("page_id")
    base = p.select("page_id", "url", tag.alias("tag"), F.coalesce(F.length("html"), F.lit(0)).alias("n"))
    response = base.select(
        (i * 2).alias("record_id"), "url", (i * 10).alias("captured_at"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), text(i).alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.col("n")), F.lit("etag"), F.col("tag"), F.lit("last-modified"), text(i), F.lit("server"), F.lit("a")).alias("headers"),
    )
    sent = F.when(i % 11 == 0, F.lit("outdated")).when(i % 13 == 0, F.lit(None)).when(i % 7 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    date = F.when(i % 26 == 0, F.lit(None)).otherwise(text(i))
    revisit = base.select(
        (i * 2 + 1).alias("record_id"), "url", (i * 10 + F.when(i % 17 == 0, -5).otherwise(5)).alias("captured_at"), F.lit("revisit").alias("kind"), sent.alias("etag"), date.alias("last_modified"),
        F.map_filter(F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), text(i * 10), F.lit("etag"), sent, F.lit("server"), F.lit("b")), lambda _, v: v.isNotNull()).alias("headers"),
    )
    return response.unionByName(revisit)


def query(pages: DataFrame) -> DataFrame:
    """Every revisit of the pages' captures, with its merged headers as text."""
    found = resolve(captures(pages))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical_url", "status", "response_id", "response_at", text.alias("headers"))


#: DuckDB SQL for query() over the view pages.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id AS i, md5(coalesce(html, '')) AS tag, coalesce(length(html), 0) AS n, regexp_replace(trim(url), '#.*$', '') AS whole FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(whole, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'], lower(string_split(p, '=')[1])))) AS kept
  FROM parts
), urls AS (
  SELECT i, tag, n, CASE WHEN host <> '' THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE whole END AS canon FROM cut
), revisits AS (
  SELECT i * 2 + 1 AS record_id, i, canon, i * 10 + CASE WHEN i % 17 = 0 THEN -5 ELSE 5 END AS at,
    CASE WHEN i % 11 = 0 THEN 'outdated' WHEN i % 13 = 0 THEN NULL WHEN i % 7 = 0 THEN 'W/' || tag ELSE tag END AS etag,
    CASE WHEN i % 26 = 0 THEN NULL ELSE CAST(i AS VARCHAR) END AS modified
  FROM urls
), joined AS (
  SELECT r.*, f.i AS f_i, f.tag AS f_tag, f.n AS f_n, row_number() OVER (PARTITION BY r.record_id ORDER BY f.i DESC) AS pick
  FROM revisits r LEFT JOIN urls f ON f.canon = r.canon AND f.i * 10 < r.at
), told AS (
  SELECT *, CASE WHEN f_i IS NULL THEN 'unresolved' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NULL THEN 'unverified' WHEN modified = CAST(f_i AS VARCHAR) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM joined WHERE pick = 1
)
SELECT record_id, canon AS canonical_url, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN f_i * 2 END AS response_id,
  CASE WHEN status IN ('resolved', 'unverified') THEN f_i * 10 END AS response_at,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'content-length=' || f_n || ';content-type=text/html;date=' || (i * 10) || ';etag=' || coalesce(etag, f_tag) || ';last-modified=' || f_i || ';server=b' END AS headers
FROM told
"""
