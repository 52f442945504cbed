"""Tables of a folder, and the bindings by which the test tables stand for a crawl, its cache and its queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import AS_OF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def url_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch history: a page an hour from 2024 on."""
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id") * F.lit(3600000000))
    return pages(spark, sf_dir).select(F.col("page_id").alias("raw_id"), U.normalize_url(F.col("url")).alias("url"), "html", at.alias("fetched_at"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue events of users as documents, with an instant as time."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "enqueue", "view", "start", "purchase", "complete", "error", "fail", "click", "touch")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("doc/"), F.col("user_id")).alias("url"), F.element_at(kinds, F.col("event_type")).alias("event"), F.col("ts").cast("timestamp").alias("at"), "value", "props")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk embeddings: a label's vectors are a document's chunks."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") % 2 == 0, "html").otherwise("pdf")
    return e.select(F.concat(F.lit("doc/"), F.col("label")).alias("url"), kind.alias("doc_type"), F.col("vec_id").alias("chunk_id"), "embedding")


def pdf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans of PDF pages from order lines: ten orders are a document, lines of one number a page.

    Of lines with the same order and number the smallest (part, supplier, quantity) counts.
    """
    i = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    body = F.repeat(F.concat(F.lit("part "), part, F.lit(" of "), F.col("l_suppkey"), F.lit(" ")), F.col("l_quantity").cast("int") % 12 + 1)
    text = F.when(F.col("l_linenumber") == 1, "Report of parts and suppliers").when(part % 4 == 0, F.concat(F.lit("Section "), part)).otherwise(F.trim(body))
    span = F.struct(text.alias("text"), (F.lit(8.0) + part % 9 * F.lit(0.5)).alias("size"))
    keys = [F.floor(F.col("l_orderkey") / 10).alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no"), F.col("l_orderkey").alias("span_no")]
    one = i.groupBy(*keys).agg(F.min_by(span, F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("s"))
    return one.select("doc_id", "page_no", "span_no", "s.text", "s.size")
