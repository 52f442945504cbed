"""PDF layout from text spans (doc_id, page_no, span_no, text, size)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_artifact
from ..sources.shared import bounded

#: Words after which a heading goes on.
CONTINUES = ("the", "a", "an", "of", "in", "on", "for", "to", "with", "by", "from", "at", "as", "is", "are", "was", "were")
HEADINGS = ("title", "h1", "h2", "h3", "h4")


def font_statistics(spans: DataFrame) -> DataFrame:
    """For each document the body size (most characters; the smaller of equals), the upper median, sizes of headings and subtext."""
    n = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = n.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    base = ranked.groupBy("doc_id").agg(
        F.max_by("size", F.struct("n", -F.col("size"))).alias("body"), F.max("size").alias("title"), F.min("size").alias("least"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("size"))).alias("median"),
    )
    above = n.join(base, "doc_id").filter(F.col("size") > F.col("body"))
    heads = above.groupBy("doc_id").agg(
        F.max_by("size", F.struct("n", -F.col("size"))).alias("h4"), F.max_by("size", F.when(F.col("size") < F.col("title"), F.struct("n", -F.col("size")))).alias("under"),
    )
    s = base.join(heads, "doc_id", "left")
    none, body = F.col("h4").isNull(), F.col("body")
    h1 = F.when(none, body * 1.5).otherwise(F.coalesce("under", F.col("title") * 0.8))
    s = s.withColumn("h1", h1)
    wide = F.col("h1") > F.col("h4")
    step = (F.col("h1") - F.col("h4")) / 3
    return s.select(
        "doc_id", "median", "body", "title", "h1",
        F.when(none, body * 1.3).when(wide, F.col("h1") - step).otherwise(F.col("h4") * 0.85).alias("h2"),
        F.when(none, body * 1.2).when(wide, F.col("h4") + step).otherwise(F.col("h4") * 0.7).alias("h3"),
        F.when(none, body * 1.1).otherwise(F.col("h4")).alias("h4"), F.when(F.col("least") < body, F.col("least")).otherwise(body * 0.8).alias("subtext"),
    )


def type_by_size(size: Column, text: Column) -> Column:
    """A span's kind under its document's thresholds; more than 20 words are body."""
    long = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) > 20
    out = F.when(long, "body")
    for kind in HEADINGS:
        out = out.when(size >= F.col(kind), kind)
    return out.when(size >= F.col("body") * 0.95, "body").otherwise("subtext")


def grid(size: Column) -> Column:
    """Quarter points; halves round to even."""
    return F.bround(size * 4) / 4


def top_sizes(spans: DataFrame, n: int = 10) -> DataFrame:
    """The n sizes of each document with the most characters, and the body size among them."""
    c = spans.groupBy("doc_id", grid(F.col("size")).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "size")
    top = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.withColumn("body", F.first("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def classify(spans: DataFrame, longest: int = 200, title_least: int = 10) -> DataFrame:
    """Block types by quartile bands between the body size and the title size (the largest size above it with a text of ten characters)."""
    top = top_sizes(spans).select("doc_id", F.col("size").alias("g"), "rank")
    s = spans.withColumn("g", grid(F.col("size"))).join(top, ["doc_id", "g"], "left")
    doc = Window.partitionBy("doc_id")
    s = s.withColumn("body_pt", F.max(F.when(F.col("rank") == 1, F.col("g"))).over(doc))
    large = (F.col("g") > F.col("body_pt")) & F.col("rank").isNotNull() & (F.length(F.trim("text")) >= title_least)
    s = s.withColumn("title_pt", F.max(F.when(large, F.col("g"))).over(doc))
    g, b, t = F.col("g"), F.col("body_pt"), F.col("title_pt")
    r = (g - b) / (t - b)
    n = F.length(F.trim("text"))
    band = F.when(r > 0.75, "heading1").when(r > 0.5, "heading2").when(r > 0.25, "heading3").otherwise("heading4")
    kind = (
        F.when(F.col("rank").isNull(), F.when(F.abs(g - b) <= 0.5, "paragraph").otherwise("subtext"))
        .when(n > longest, "paragraph")
        .when((F.abs(g - t) < 0.01) & (n >= title_least), "title")
        .when(F.abs(g - b) <= 0.25, "paragraph")
        .when(g <= b - 1.0, "subtext")
        .when((g > b) & (g < t), band)
        .otherwise("paragraph")
    )
    return s.select("doc_id", "page_no", "span_no", "text", "size", kind.alias("type"))


def repeated_blocks(spans: DataFrame, least_pages: int = 8, share: float = 0.5, least_chars: int = 10) -> DataFrame:
    """Texts that stand on at least `share` of a document's pages, in documents of `least_pages` or more: headers and footers."""
    t = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    pages = spans.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    seen = spans.select("doc_id", "page_no", t.alias("text")).filter(F.length("text") >= least_chars).groupBy("doc_id", "text").agg(F.count_distinct("page_no").alias("on_pages"))
    return seen.join(pages, "doc_id").filter((F.col("pages") >= least_pages) & (F.col("on_pages") >= F.floor(F.col("pages") * share)))


def _merge(spans: list[dict]) -> list[dict]:
    """Blocks (type, text, size) of a page's spans in order."""
    out: list[dict] = []
    now: dict | None = None
    for r in spans:
        text = r["text"]
        if now is not None:
            last = now["text"].rstrip()
            word = last.split()[-1] if last.split() else ""
            s = text.strip()
            goes_on = bool(last) and last[-1] not in ".!?:;,’" and bool(s) and (s[0].islower() or word.endswith(("’s", "'s", "’")) or word.lower() in CONTINUES)
            if now["type"] == r["type"] or goes_on:
                joint = "" if now["text"].endswith((" ", "\n", "\t", "-")) or text.startswith((" ", "\n", "\t")) else " "
                now["text"] += joint + text
                continue
        now = {"type": r["type"], "text": text, "size": r["size"]}
        out.append(now)
    return out


def _blocks_of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block from rows of pages (doc_id, page_no, spans)."""
    names = ["doc_id", "page_no", "block_no", "type", "text", "size"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    for batch in batches:
        rows = [(d, p, i, b["type"], b["text"], b["size"]) for d, p, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, b in enumerate(_merge(spans))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Blocks of a page: neighbouring spans of one kind, and sentences that go on. A row is one page's spans. Headings of more than 25 words or 150 characters are body."""
    s = spans.filter(~is_artifact(F.col("text"))).join(font_statistics(spans), "doc_id")
    typed = s.select("doc_id", "page_no", "span_no", "text", "size", type_by_size(F.col("size"), F.col("text")).alias("type"))
    # many pages have few spans each: a batch holds many of them, where a pandas frame for each costs more than its work
    bounded(spans.sparkSession)
    pages = typed.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("span_no", "type", "text", "size"))).alias("spans"))
    b = pages.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("bigint"), "spans").mapInArrow(_blocks_of_pages, "doc_id bigint, page_no bigint, block_no bigint, type string, text string, size double")
    text = F.trim("text")
    long = (F.size(F.split(text, r"(?U)\s+")) > 25) | (F.length(text) > 150)
    kind = F.when(F.col("type").isin(*HEADINGS) & long, "body").otherwise(F.col("type"))
    return b.select("doc_id", "page_no", "block_no", kind.alias("type"), text.alias("text"), "size", F.col("type").alias("original_type"))


def document_title(spans: DataFrame, pages: int = 3) -> DataFrame:
    """A title from the first pages: of title size, else a heading, else the first text's first 100 characters."""
    typed = spans.filter(F.col("page_no") <= pages).join(font_statistics(spans), "doc_id")
    kind = type_by_size(F.col("size"), F.col("text"))
    rank = F.when(kind == "title", 0).when(kind.isin(*HEADINGS), 1).otherwise(2)
    text = F.when(rank == 2, F.substring("text", 1, 100)).otherwise(F.col("text"))
    return typed.groupBy("doc_id").agg(F.min_by(text, F.struct(rank, "page_no", "span_no")).alias("title"))


def fingerprint(title: Column, author: Column, date: Column, size: Column) -> Column:
    """SHA-256 of title, author, date and size."""
    part = lambda c: F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return F.sha2(F.concat_ws("|", part(title), part(author), part(date), part(size)), 256)


def page_texts(spans: DataFrame) -> DataFrame:
    """Each page's text, its spans in order, with counts of characters, words and spans."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"])
    p = spans.groupBy("doc_id", "page_no").agg(F.array_join(parts, " ").alias("text"), F.count(F.lit(1)).alias("n_spans"))
    return p.select("doc_id", "page_no", "text", F.length("text").alias("n_chars"), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("n_words"), "n_spans")


def header_footer(blocks: DataFrame, margin: float = 8.0, recurrence: float = 60.0, single_pages: bool = True) -> DataFrame:
    """blocks (doc_id, page_no, block_no, text, bbox: x0 y0 x1 y1 or null) with is_header_footer.

    A block is one within `margin` per cent of the page's height from top or
    bottom, or with a text on `recurrence` per cent of the pages. The height is
    that of the first box on the first three pages, and 50 points; without any,
    792. In a document of one page every text recurs; single_pages=False leaves
    recurrence out there.
    """
    box = F.size("bbox") == 4
    first = blocks.filter((F.col("page_no") <= 3) & box).groupBy("doc_id").agg(F.min_by("bbox", F.struct("page_no", "block_no")).alias("box"))
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages")).join(first, "doc_id", "left")
    pages = pages.select("doc_id", "n_pages", F.coalesce(F.greatest(F.col("box")[1], F.col("box")[3]) + 50, F.lit(792.0)).alias("height"))
    t = F.trim("text")
    seen = blocks.filter(t != "").groupBy("doc_id", t.alias("line")).agg(F.count_distinct("page_no").alias("on_pages"))
    b = blocks.withColumn("line", t).join(pages, "doc_id").join(seen, ["doc_id", "line"], "left")
    edge = F.col("height") * margin / 100
    at_edge = F.coalesce(box & ((F.col("bbox")[1] <= edge) | (F.col("bbox")[3] >= F.col("height") - edge)), F.lit(False))
    again = F.col("on_pages") >= F.col("n_pages") * recurrence / 100
    if not single_pages:
        again = again & (F.col("n_pages") > 1)
    return b.select("doc_id", "page_no", "block_no", "text", ((t != "") & (at_edge | F.coalesce(again, F.lit(False)))).alias("is_header_footer"))


_TEXTS = ("title", "heading1", "heading2", "heading3", "heading4", "paragraph", "subtext")


def nested(blocks: DataFrame) -> DataFrame:
    """doc_id and content, an array of sections (section_id, headers, chunks: array of (chunk_id, page_no, char_count, blocks: array of (block_no, type, size, text))), from blocks (doc_id, page_no, span_no, type, size, text).

    A section is a stack of headers and what follows it up to the next one; its chunks are its pages', numbered
    through the document. Blocks, chunks and sections are gathered level by level, so that a row is never more than one document.
    """
    from .chunking import _islands

    b = blocks.filter(F.col("type").isin(*_TEXTS))
    head = F.col("type").isin(*_TEXTS[:5])
    s = _islands(b, ["doc_id"], ["page_no", "span_no"], head, ["doc_id"])
    block = F.struct(F.col("span_no").alias("block_no"), "type", "size", "text")
    c = s.groupBy("doc_id", "island", "page_no").agg(
        F.array_sort(F.collect_list(block)).alias("blocks"), F.sum(F.length("text")).cast("int").alias("char_count"), F.array_sort(F.collect_list(F.when(head, F.struct("span_no", "text")))).alias("heads"),
    )
    c = c.withColumn("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island", "page_no")))
    chunk = F.struct("chunk_id", "page_no", "char_count", "blocks", "heads")
    one = c.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    one = one.select(
        "doc_id", F.col("island").alias("section_id"), F.flatten(F.transform("c", lambda x: F.transform(x["heads"], lambda h: h["text"]))).alias("headers"),
        F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["page_no"].alias("page_no"), x["char_count"].alias("char_count"), x["blocks"].alias("blocks"))).alias("chunks"),
    )
    return one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "headers", "chunks"))).alias("content"))


def diagnostics(blocks: DataFrame, n: int = 10) -> DataFrame:
    """Of each document (doc_id): its ten sizes with most characters as (size, chars), the number of sizes and of characters, and blocks by type (a map)."""
    sizes = blocks.groupBy("doc_id", grid(F.col("size")).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    s = sizes.groupBy("doc_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("less"), "size"))), 1, n), lambda x: F.struct(x["size"].alias("size"), (-x["less"]).alias("chars"))).alias("top_sizes"),
        F.count(F.lit(1)).alias("n_sizes"), F.sum("chars").alias("n_chars"),
    )
    types = blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("block_counts"))
    return s.join(types, "doc_id")
