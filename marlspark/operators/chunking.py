"""Chunks of texts: by words, paragraphs, characters, and packed from parts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, words


def word_chunks(docs: DataFrame, key: str, text: str = "text", size: int = 500, step: int = 450, least: int = 50) -> DataFrame:
    """Overlapping chunks of `size` words, every `step` words, of at least `least` words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.slice(w, i + 1, size)), lambda c: F.size(c) >= least)

    d = docs.select(key, F.posexplode(let(words(F.col(text)), cut)).alias("chunk_id", "words"))
    return d.select(key, "chunk_id", F.array_join("words", " ").alias("chunk"), F.size("words").alias("n_words"))


def paragraph_chunks(docs: DataFrame, key: str, text: str = "text", mark: str = "\n\n") -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(text), mark), lambda p: F.trim(p)), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("chunk_id", "chunk"))


def split_chunks(docs: DataFrame, key: str, text: str = "text", heading: str | None = None, most: int = 1000) -> DataFrame:
    """Slices of at most `most` characters; the first leaves room for the heading, later ones name it."""
    t = F.col(text)
    h = F.col(heading) if heading else F.lit("")
    head = F.when(h == "", F.lit(most)).otherwise(F.greatest(F.lit(1), F.lit(most) - F.length(h) - 1))
    n = F.length(t)
    later = F.when(n > head, F.sequence(head, F.greatest(head, n - 1), F.lit(most))).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(0)), later)
    d = docs.select(key, t.alias("_t"), h.alias("_h"), head.alias("_first"), F.posexplode(starts).alias("_k", "_start"))
    part = F.substring(F.col("_t"), F.col("_start") + 1, F.when(F.col("_k") == 0, F.col("_first")).otherwise(F.lit(most)))
    lead = F.when((F.col("_k") > 0) & (F.col("_h") != ""), F.concat(F.lit("(continued from: "), F.col("_h"), F.lit(")\n"))).otherwise(F.lit(""))
    return d.select(key, F.concat(F.lit("cs"), F.col("_k") + 1).alias("chunk_id"), F.col("_start").alias("start"), F.concat(lead, part).alias("chunk"), F.length(part).alias("n_chars"))


def packed(sizes: list[int], most: int) -> list[int]:
    """Greedy packing of sizes in order: the chunk of each, a new one where the sum would pass `most`."""
    out, total, at = [], 0, 0
    for n in sizes:
        if total and total + n > most:
            at, total = at + 1, 0
        total += n
        out.append(at)
    return out


def merged(sizes: list[int], least: int) -> list[int]:
    """Groups of sizes in order so that each sums to `least`: a small one takes the next, the last goes to the one before."""
    out, total, at = [], 0, 0
    for n in sizes:
        if total >= least:
            at, total = at + 1, 0
        total += n
        out.append(at)
    return [min(g, at - 1) for g in out] if total < least and at else out


def _numbered(f, limit: int):
    """f over a column of arrays: a running sum that starts anew is no built-in, and an aggregate would copy its array at every step."""
    return F.pandas_udf(lambda s: s.map(lambda x: f([int(i) for i in x], limit)), "array<int>")


def chunk_numbers(sizes: Column, most: int = 1000) -> Column:
    return _numbered(packed, most)(sizes)


def pack_parts(parts: DataFrame, key: str, order: str, text: str = "text", most: int = 1000) -> DataFrame:
    """Parts of a key, in order, packed greedily into chunks. A key's parts are one document's."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
    g = g.select(key, "parts", chunk_numbers(F.transform("parts", lambda p: F.length(p["t"])), most).alias("chunk"))
    z = g.select(key, F.explode(F.arrays_zip("parts", "chunk")).alias("z"))
    return z.groupBy(key, F.col("z.chunk").alias("chunk_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("z.parts")), lambda p: p["t"]), "\n").alias("chunk"), F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("z.parts.t")).alias("n_chars"),
    )


def merge_small(sizes: Column, least: int = 500) -> Column:
    return _numbered(merged, least)(sizes)


def merge_chunks(chunks: DataFrame, key: str, order: str, text: str = "chunk", least: int = 500) -> DataFrame:
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
    g = g.select(key, "parts", merge_small(F.transform("parts", lambda p: F.length(p["t"])), least).alias("to"))
    z = g.select(key, F.explode(F.arrays_zip("parts", "to")).alias("z"))
    return z.groupBy(key, F.col("z.to").alias("chunk_id")).agg(
        F.transform(F.array_sort(F.collect_list("z.parts")), lambda p: p["o"]).alias("merged_from"), F.sum(F.length("z.parts.t")).alias("n_chars"),
    )


def sections(blocks: DataFrame, doc: str, order: list[str], heading: Column) -> DataFrame:
    """Numbers each document's blocks by section: a new one begins at every heading; what is before the first is section 0."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_id", F.sum(F.when(heading, 1).otherwise(0)).over(w))


def _islands(blocks: DataFrame, within: list[str], order: list[str], heading: Column, doc: list[str]) -> DataFrame:
    """blocks with `island`: a new one begins with the first block of `within`, and at a heading that follows content."""
    w = Window.partitionBy(*within).orderBy(*order)
    begins = F.lag(heading).over(w).isNull() | (heading & ~F.lag(heading).over(w))
    every = Window.partitionBy(*doc).orderBy(*dict.fromkeys([*within, *order])).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_begins", begins).withColumn("island", F.sum(F.col("_begins").cast("int")).over(every)).drop("_begins")


def _in_order(order: list[str], keep: Column, text: str = "text") -> Column:
    """The texts of a group's rows that `keep` holds for, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(*order, F.col(text).alias("t"))))), lambda x: x["t"])


def page_chunks(blocks: DataFrame, headings: tuple[str, ...] = ("title", "h1", "h2", "h3", "h4"), content: tuple[str, ...] = ("body", "subtext")) -> DataFrame:
    """Chunks of pages from blocks (doc_id, page_no, block_no, type, text): headings and what follows them up to the next heading.

    Chunks of headings alone give them to the next chunk with content, on
    whatever page; what is left over at the end stands alone. Headers and footers
    are no blocks here. A group is one document's blocks.
    """
    b = blocks.filter(F.col("type").isin(*headings, *content))
    head = F.col("type").isin(*headings)
    order = ["page_no", "block_no"]
    c = _islands(b, ["doc_id", "page_no"], ["block_no"], head, ["doc_id"]).groupBy("doc_id", "island").agg(
        F.min("page_no").alias("page_no"), _in_order(order, head).alias("headings"), F.array_join(F.transform(_in_order(order, ~head), lambda t: F.concat(t, F.lit("\n"))), "").alias("content"),
    )
    full = F.trim(F.regexp_replace("content", "\n", " ")) != ""
    before = Window.partitionBy("doc_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    g = c.withColumn("chunk_no", F.coalesce(F.sum(full.cast("int")).over(before), F.lit(0)) + 1).withColumn("full", full)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("island", "headings"))), lambda x: x["headings"]))
    return g.groupBy("doc_id", "chunk_no").agg(
        F.coalesce(F.max(F.when(F.col("full"), F.col("page_no"))), F.max("page_no")).alias("page_no"), joined.alias("headings"), F.coalesce(F.max(F.when(F.col("full"), F.col("content"))), F.lit("")).alias("content"),
    )


def header_sections(blocks: DataFrame, headers: tuple[str, ...] = ("title", "heading1", "heading2", "heading3", "heading4"), bodies: tuple[str, ...] = ("paragraph", "subtext")) -> DataFrame:
    """Sections of documents from blocks (doc_id, page_no, block_no, type, text): a stack of headers, and the text up to the header after it."""
    b = blocks.filter(F.col("type").isin(*headers, *bodies))
    head, order = F.col("type").isin(*headers), ["page_no", "block_no"]
    s = _islands(b, ["doc_id"], order, head, ["doc_id"])
    return s.groupBy("doc_id", F.col("island").alias("section_id")).agg(_in_order(order, head).alias("headers"), F.array_join(_in_order(order, ~head), " ").alias("section_text"), F.count_if(~head).alias("n_blocks"))


def cut_at_spaces(text: str | None, most: int = 1000) -> list[tuple[int, int, str]]:
    """(start, end, trimmed text) of stretches of at most `most` characters that end after a space where they have one; blank ones are left out."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text) and (space := text.rfind(" ", at, end)) > at:
            end = space + 1
        if part := text[at:end].strip():
            out.append((at, end, part))
        at = end
    return out


def space_chunks(docs: DataFrame, key: str, text: str = "text", most: int = 1000) -> DataFrame:
    """key, char_start, char_end, chunk."""
    kind = "array<struct<char_start:int,char_end:int,chunk:string>>"

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"char_start": a, "char_end": z, "chunk": c} for a, z, c in cut_at_spaces(t, most)])

    return docs.select(key, F.explode(F.pandas_udf(run, kind)(F.col(text))).alias("c")).select(key, "c.*")


def chunk_list(nested: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Chunks of a document's content, an array of sections (chunks: array of (chunk_id, char_count, blocks: array of (text))): blocks joined, blank chunks left out."""
    c = nested.select(key, F.explode(F.flatten(F.transform(content, lambda s: F.coalesce(s["chunks"], F.array())))).alias("c"))
    t = F.trim(F.array_join(F.transform("c.blocks", lambda b: F.coalesce(b["text"], F.lit(""))), " "))
    c = c.select(key, "c.chunk_id", t.alias("text"), "c.char_count").filter("text <> ''")
    return c.select(key, "chunk_id", "text", F.size(words(F.col("text"))).alias("n_words"), F.coalesce("char_count", F.length("text")).alias("n_chars"))


def page_union(a: Column, b: Column) -> Column:
    """Page numbers of merged chunks: each once, in order."""
    return F.array_sort(F.array_union(a, b))


def batches(rows: DataFrame, doc: str, order: str, n_chars: str, most: int = 500, chars: int = 25_000) -> DataFrame:
    """doc, order, n_chars and batch_no (from 0 in each document): a batch ends before it would hold more than `most` rows or `chars` characters; a longer row is a batch alone.

    A document's rows are read in order, and only its running sums are kept between Arrow batches. A null length counts as 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = rows.select(doc, order, n_chars).repartition(doc).sortWithinPartitions(doc, order)
    schema = ordered.select("*", F.lit(0).alias("batch_no")).schema
    names, kinds = schema.names, to_arrow_schema(schema).types

    def run(arrow):
        last, batch, items, total = object(), 0, 0, 0
        for b in arrow:
            out = []
            for d, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = n or 0
                if d != last:
                    last, batch, items, total = d, 0, 0, 0
                elif items >= most or total + n > chars:
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + n
                out.append(batch)
            columns = [*b.columns, pa.array(out, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)
