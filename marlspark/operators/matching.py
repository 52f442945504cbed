"""Aligns a chunk with its source text, and result lists of search providers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, words
from ..functions.urls import url_lane

MATCH = "match_type string, start_char int, end_char int, before string, matched string, after string"


def align(text: str | None, chunk: str | None, context: int = 200) -> tuple | None:
    """Where a chunk stands in a text, white space aside: (exact, start, end, before, matched, after); else the paragraph that holds it or is held by it with most words in common."""
    if not text or not chunk or not chunk.split():
        return None
    # the n-th character that isn't white space is the n-th of the squeezed text
    places = [i for i, c in enumerate(text) if not c.isspace()]
    squeezed, wanted = "".join([text[i] for i in places]), "".join(chunk.split())
    at = squeezed.find(wanted)
    if at >= 0:
        kind, a, z = "exact", places[at], places[at + len(wanted) - 1] + 1
    else:
        c, best, pos = " ".join(chunk.split()), None, 0
        for part in text.split("\n\n"):
            p = " ".join(part.split())
            shared = len(set(c.split()) & set(p.split())) if p and (c in p or p in c) else 0
            if shared and (best is None or shared > best[0]):
                best = (shared, pos, pos + len(part))
            pos += len(part) + 2
        if best is None:
            return None
        kind, (_, a, z) = "fuzzy", best
    return kind, a, z, text[max(0, a - context) : a], text[a:z], text[z : z + context]


def align_columns(text: Column, chunk: Column) -> Column:
    """A struct of MATCH; nulls where nothing matches."""
    names = [f.split()[0] for f in MATCH.split(", ")]

    def run(t: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(a, b) or (None,) * len(names) for a, b in zip(t, c, strict=True)], columns=names).astype({"start_char": "Int32", "end_char": "Int32"})

    return F.pandas_udf(run, MATCH)(text, chunk)


def align_chunks(chunks: DataFrame, sources: DataFrame, key: str = "url") -> DataFrame:
    """chunks (key, chunk_id, chunk) against sources (key, text), one text for each key."""
    j = chunks.join(sources.select(key, F.col("text").alias("_text")), key)
    return j.withColumn("m", align_columns(F.col("_text"), F.col("chunk"))).select(key, "chunk_id", "m.*")


def word_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(words(normalize_text(a))), F.array_distinct(words(normalize_text(b)))))


def flatten_results(serp: DataFrame) -> DataFrame:
    """A provider's lists (query_id, kind, items: array of title, link, snippet, resources) as rows with positions; scholar items' resources follow their item."""
    i = serp.select("query_id", "kind", F.posexplode("items").alias("pos", "i")).filter("i.link IS NOT NULL")
    own = i.select("query_id", "kind", "pos", F.lit(0).alias("sub"), F.col("i.link").alias("url"), F.col("i.title").alias("title"), F.col("i.snippet").alias("snippet"))
    more = i.filter("kind = 'scholar'").select("query_id", "kind", "pos", "i.snippet", F.posexplode("i.resources").alias("k", "r")).filter("r.link IS NOT NULL")
    more = more.select("query_id", "kind", "pos", (F.col("k") + 1).alias("sub"), F.col("r.link").alias("url"), F.concat(F.coalesce("r.title", F.lit("")), F.lit(" (PDF)")).alias("title"), "snippet")
    return own.unionByName(more)


def rename_results(rows: DataFrame) -> DataFrame:
    """Another provider's fields under the common names: href, url or content as link, body or description as snippet; a link must not be empty."""
    def have(*names: str) -> Column:
        found = [F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = rows.select("title", have("href", "content", "url", "link").alias("link"), have("body", "description", "snippet").alias("snippet"))
    return out.filter("link IS NOT NULL")


def concat_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Result pages (page, position, url) as one list, each URL at its first place, numbered (page - 1) * 10 + position + 1."""
    p = pages.withColumn("place", (F.col("page") - 1) * 10 + F.col("position") + 1)
    first = p.groupBy("url").agg(F.min("place").alias("place")).withColumn("lane", url_lane(F.col("url")))
    return first.orderBy("place", "url").limit(limit) if limit else first


def outcome_counts(results: DataFrame, *by: str) -> DataFrame:
    """Totals by outcome, over all or by group; what waits in the background counts apart."""
    s = F.col("status")
    return results.groupBy(*by).agg(
        F.count_if(s == "success").alias("successful"), F.count_if(s == "filtered").alias("filtered"), F.count_if(s.isin("error", "failed")).alias("failed"), F.count_if(s.startswith("background")).alias("deferred"),
    )


def settings_key(settings: Column) -> Column:
    """Settings (a map) without nulls as JSON with sorted keys."""
    kept = F.filter(F.map_entries(settings), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(kept)))


def time_filter(period: Column, start: Column, end: Column) -> Column:
    """A search provider's time parameter."""
    day = lambda d: F.date_format(d, "MM/dd/yyyy")
    return (
        F.when(period.isin("day", "week", "month", "year"), F.concat(F.lit("qdr:"), F.substring(period, 1, 1)))
        .when((period == "custom") & start.isNotNull() & end.isNotNull(), F.concat(F.lit("cd_min:"), day(start), F.lit(",cd_max:"), day(end)))
        .otherwise(F.lit(None).cast("string"))
    )


def total_results(pages: Column, videos: Column, scholar: Column, document: Column) -> Column:
    return pages * (1 + videos.cast("int") + scholar.cast("int")) + 10 * document.cast("int")
