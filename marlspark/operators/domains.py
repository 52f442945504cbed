"""Registrable domains by a table of public-suffix rules: plain, wildcard (`*.ck`) and exception (`!www.ck`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import TWO_LABEL_SUFFIXES

#: Wildcards and exceptions beside the suffixes of two labels. The whole public list is a table of the application's own.
WILDCARDS = ("*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "*.er", "*.fk", "*.mm", "*.np", "*.bd")


def rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """rule: of a file in the public list's format, or the short list that the library has."""
    if path is None:
        return spark.createDataFrame([(r,) for r in (*TWO_LABEL_SUFFIXES, *WILDCARDS)], "rule string")
    lines = spark.read.text(path).select(F.lower(F.split(F.trim("value"), r"\s+")[0]).alias("rule"))
    return lines.filter("rule <> '' AND NOT rule LIKE '//%'").distinct()


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct `host`s with public_suffix and domain, which has one label more.

    Each suffix of a host meets the rules by their text, as it stands, as a wildcard's and as an exception's: no host is
    compared with all rules. An exception holds before the longest rule; without a rule the last label is the suffix. A host
    that is a public suffix, a number or a single label is its own domain.
    """
    h = hosts.select("host").filter("host IS NOT NULL").distinct().withColumn("labels", F.split(F.regexp_replace(F.lower("host"), r"\.$", ""), r"\."))
    n = F.size("labels")
    each = h.select("host", "labels", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    suffix = lambda i: F.array_join(F.slice("labels", i, n), ".")
    s = each.withColumn("own", suffix(F.col("i")))
    wild = F.when(F.col("i") < n, F.concat(F.lit("*."), suffix(F.col("i") + 1)))
    keys = s.select("host", (n - F.col("i") + 1).alias("long"), F.explode(F.array(F.struct(F.col("own").alias("rule"), F.lit(0).alias("kind")), F.struct(wild.alias("rule"), F.lit(0).alias("kind")), F.struct(F.concat(F.lit("!"), F.col("own")).alias("rule"), F.lit(1).alias("kind")))).alias("k"))
    hit = keys.select("host", "long", "k.*").join(rules.select("rule").distinct(), "rule")
    best = hit.groupBy("host").agg(F.max(F.struct("kind", "long")).alias("b")).select("host", (F.col("b.long") - F.col("b.kind")).alias("size"))
    out = h.join(best, "host", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", F.greatest(n - k + 1, F.lit(1)), n), ".")
    number = F.col("host").rlike(r"^[\d.]+$") | F.col("host").startswith("[")
    return out.select("host", F.when(~number, last(F.col("size"))).alias("public_suffix"), F.when(number, F.col("host")).otherwise(last(F.col("size") + 1)).alias("domain"))
