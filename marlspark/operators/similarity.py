"""Shingle fingerprints, overlaps, and TF-IDF similarity."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words without weight of their own.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def fingerprint(docs: DataFrame, key: str, text: str = "text", size: int = 5, keep: int = 10) -> DataFrame:
    """MD5 of the lower-cased text, words, distinct shingles and the `keep` smallest shingle hashes."""
    low = F.lower(F.col(text))
    s = T.shingles(F.col(text), size)
    sketch = F.slice(F.array_sort(F.transform(s, lambda x: F.xxhash64(x))), 1, keep)
    return docs.select(key, F.md5(low).alias("content_md5"), T.word_count(low).alias("n_words"), F.size(s).alias("n_shingles"), sketch.alias("sketch"))


def shingle_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", size: int = 5) -> DataFrame:
    """Pairs of keys with the number of distinct shingles that both have: an equi-join on two 64-bit hashes of a shingle, so that no words are shuffled; the smaller side is broadcast while Spark finds it small."""

    def hashed(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(T.shingles(F.col(text), size)).alias("g")).select(key, F.xxhash64("g").alias("g1"), F.xxhash64(F.lit(1), F.col("g")).alias("g2"))

    return hashed(left, left_key).join(hashed(right, right_key), ["g1", "g2"]).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))


def _terms(tokens: Iterable[str], most: int) -> dict[str, int]:
    """The `most` most frequent terms with their counts; equals by code points."""
    n = Counter(w for w in tokens if len(w) >= 2 and w not in STOP_WORDS)
    return dict(sorted(n.items(), key=lambda e: (-e[1], e[0]))[:most])


def _cosine(a: dict[str, int], b: dict[str, int]) -> float:
    rare = math.log(1.5) + 1.0
    va, vb = ({w: n * (1.0 if w in other else rare) for w, n in own.items()} for own, other in ((a, b), (b, a)))
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (va, vb))
    return sum(x * vb.get(w, 0.0) for w, x in va.items()) / (na * nb) if na and nb else 0.0


def tfidf_cosine(a: Column, b: Column, most: int = 500) -> Column:
    """Cosine of two texts' TF-IDF vectors, idf over just these two, at most `most` terms of each text by frequency. Null if a text is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else _cosine(_terms(i, most), _terms(j, most)) for i, j in zip(x, y, strict=True)], dtype="float64")

    tokens = lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}]+")
    return F.pandas_udf(run, "double")(tokens(a), tokens(b))
