"""Sitemaps and feeds: XML documents by row tag, and the dates that they give for pages.

Files are read by Spark's XML reader by row tag, one document a file, whatever
prefix a document gives its namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "true").load(path)


def feed_time(s: Column) -> Column:
    """A time as sitemaps and Atom write it (ISO, down from the year, in UTC where nothing is said), or as RSS does; null if it is neither."""
    t = F.trim(s)
    plain = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", ""), r"\s+(?:GMT|UTC?|Z)$", " +0000")
    padded = F.regexp_replace(F.when(plain.rlike(r"^\d{1,2} \w{3} \d{4} \d{2}:\d{2} "), F.regexp_replace(plain, r"(\d{2}:\d{2}) ", "$1:00 ")).otherwise(plain), r"\s+", " ")
    iso = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t)
    return F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(padded, F.lit("d MMM yyyy HH:mm:ss Z")))


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """url and modified_at of sitemaps' pages. Entries without a date are left out."""
    r = _rows(spark, path, "url", "loc string, lastmod string")
    return r.select(F.trim("loc").alias("url"), feed_time(F.col("lastmod")).alias("modified_at")).filter("url <> '' AND modified_at IS NOT NULL")


def sitemap_index(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """url and modified_at of the sitemaps that indexes name; with `since`, those that may have changed after it."""
    r = _rows(spark, path, "sitemap", "loc string, lastmod string").select(F.trim("loc").alias("url"), feed_time(F.col("lastmod")).alias("modified_at")).filter("url <> ''")
    return r if since is None else r.filter(F.col("modified_at").isNull() | (F.col("modified_at") > since))


def rss_entries(spark: SparkSession, path: str) -> DataFrame:
    """url and modified_at of RSS items: an item's update (Atom's or Dublin Core's element) before its publication. An item's guid stands for a missing link where it is an address."""
    r = _rows(spark, path, "item", "link string, guid string, pubDate string, updated string, date string")
    link = F.coalesce(F.nullif(F.trim("link"), F.lit("")), F.when(F.trim("guid").rlike("^https?://"), F.trim("guid")))
    at = F.coalesce(feed_time(F.col("updated")), feed_time(F.col("date")), feed_time(F.col("pubDate")))
    return r.select(link.alias("url"), at.alias("modified_at")).filter("url IS NOT NULL AND modified_at IS NOT NULL")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """url and modified_at of Atom entries: updated before published; of several links the first that isn't to something else."""
    r = _rows(spark, path, "entry", "link array<struct<_href:string,_rel:string>>, updated string, published string")
    own = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    at = F.coalesce(feed_time(F.col("updated")), feed_time(F.col("published")))
    return r.select(F.trim(F.get(own, 0)["_href"]).alias("url"), at.alias("modified_at")).filter("url <> '' AND modified_at IS NOT NULL")


def page_dates(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages with the latest modified_at that entries have for their url, whether or not it ends in a slash; null if none has."""
    latest = entries.groupBy(F.rtrim(F.col("url"), F.lit("/")).alias("_key")).agg(F.max("modified_at").alias("modified_at"))
    return pages.withColumn("_key", F.rtrim(F.col("url"), F.lit("/"))).join(latest, "_key", "left").drop("_key")
