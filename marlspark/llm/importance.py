"""Importance resampling towards a target distribution, by hashed n-gram counts.

Texts are lower-cased (A-Z), cut into words, and their runs of one and two words
are features, each in the bucket of its crc32. A bucket's gain is the log ratio
of its smoothed share of the target to that of the documents, in thousandths; a
document's weight is the floored mean gain of its features. Gumbel noise from a
hash of the id turns the highest scores into a draw without replacement.

Features are counted in each task before buckets are shuffled, so that a bucket
or a text with a third of all features is one row a task. The gain table, which
has a row a bucket at most, is broadcast; documents are summed, and ranked by
ranges with offsets, so that no task sees all of them. Features are exploded
as pairs of neighbours, which become a one-word and a two-word bucket each.

Defined results: a null or empty text has no words, no features and weight 0; a
null doc_id is hashed as the empty text and comes last among equal scores.
Repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import drop, materialize, pick

#: Fixed value: a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LEAST, PERCENT, SEED = 10000, 20, 25, 7


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature) % BUCKETS).cast("int")


def buckets(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each word of `text`: columns to keep, the word's bucket `one`, and that of it with the next word, `two`; a text without words has a row of nulls."""
    w = pick(rows, *keep, "text").select(*keep, words(F.col("text")).alias("words"))
    each = w.select(*keep, F.explode_outer(F.arrays_zip(F.col("words").alias("word"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))).alias("w"))
    return each.select(*keep, _bucket(F.col("w.word")).alias("one"), _bucket(F.concat("w.word", F.lit(" "), "w.next")).alias("two"))


def counts(rows: DataFrame) -> DataFrame:
    """bucket and n, the features in it over all rows."""
    both = buckets(rows).select(F.explode(F.array("one", "two")).alias("bucket")).filter("bucket IS NOT NULL")
    return both.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain for every bucket of the documents: BUCKETS rows at most, stored."""
    of_docs, of_target = materialize(counts(docs), "buckets"), materialize(counts(target), "buckets")
    s_all, t_all = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (of_docs, of_target))
    both = of_docs.withColumnRenamed("n", "s").join(of_target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(float(s_all + BUCKETS)) / ((s + 1) * F.lit(float(t_all + BUCKETS)))
    out = materialize(both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("bigint").alias("gain")), "gains")
    drop(docs.sparkSession, of_docs, of_target)
    return out


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def scored(docs: DataFrame, gain: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, n_words, n_features, weight and score of every row."""
    d = pick(docs, "doc_id", "text", *keep).withColumn("_row", F.monotonically_increasing_id())
    g = lambda name: F.broadcast(gain.select(F.col("bucket").alias(name), F.col("gain").alias(f"gain_{name}")))
    each = buckets(d, "_row", "doc_id", *keep).join(g("one"), "one", "left").join(g("two"), "two", "left")
    total = F.sum(F.coalesce("gain_one", F.lit(0)) + F.coalesce("gain_two", F.lit(0)))
    by = each.groupBy("_row", "doc_id", *keep).agg(F.count("one").alias("n_words"), (F.count("one") + F.count("two")).alias("n_features"), total.alias("total"))
    by = by.withColumn("weight", F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)"))
    return by.select("doc_id", *keep, "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"))).alias("score"))


def drawn(scores: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """All of stored scores with `rank`: from 1 for the highest scores of so many percent of the documents that have `least` words, null for the rest."""
    long = scores.filter(F.col("n_words") >= least)
    n = long.count() * percent // 100
    ties = [F.col(c).asc_nulls_last() for c in scores.columns if c not in ("score", "doc_id")]
    ranked = global_rank(long, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *ties])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank").cast("bigint")))
    return ranked.unionByName(scores.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """The drawn documents: doc_id, text, weight, score, rank."""
    rows = materialize(pick(docs, "doc_id", "text").withColumn("key", F.monotonically_increasing_id()), "rows")
    scores = materialize(scored(rows, gains(rows, target), "key"), "scores")
    found = drawn(scores, percent, least).filter("rank IS NOT NULL").select("key", "weight", "score", "rank")
    return rows.join(found, "key").drop("key")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    gain = gains(docs, target)
    scores = materialize(scored(docs, gain), "scores")
    return drawn(scores).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL for query() over the views documents and benchmark. crc32 goes byte by byte over distinct features.
ORACLE_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), step AS (
  SELECT i::BIGINT AS i, c FROM bits WHERE k = 8
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark
), split AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, r, unnest(w) AS f FROM split UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
), told AS MATERIALIZED (
  SELECT side, r, f, count(*) AS n FROM features GROUP BY ALL
), crc(f, h, k, c) AS (
  SELECT f, hex(encode(f)), 0, 4294967295::BIGINT FROM (SELECT DISTINCT f FROM told)
  UNION ALL SELECT f, h, k + 1, xor(crc.c >> 8, step.c) FROM crc JOIN step ON step.i = xor(crc.c & 255, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) WHERE k < len(h) // 2
), hashed AS (
  SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE k = len(h) // 2
), placed AS MATERIALIZED (
  SELECT side, r, b, sum(n)::BIGINT AS n FROM told JOIN hashed USING (f) GROUP BY ALL
), sums AS (
  SELECT b, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM placed GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM sums
), per AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM placed JOIN gain USING (b) WHERE side = 's' GROUP BY r
), weighed AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM split LEFT JOIN per USING (r) WHERE side = 's'
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END::BIGINT AS rank
FROM ranked
"""
