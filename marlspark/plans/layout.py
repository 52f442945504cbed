"""Chunks and PDF layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import layout as L
from ..registry import query
from ..sources.tables import pdf_spans, table
from .web import _WORDS

_SPANS = """i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem),
spans AS (SELECT l_orderkey // 10 AS doc_id, l_linenumber::BIGINT AS page_no, l_orderkey AS span_no, 8::DOUBLE + (l_partkey % 9) * 0.5::DOUBLE AS size,
  CASE WHEN l_linenumber = 1 THEN 'Report of parts and suppliers' WHEN l_partkey % 4 = 0 THEN 'Section ' || l_partkey
    ELSE trim(repeat('part ' || l_partkey || ' of ' || l_suppkey || ' ', l_quantity::INT % 12 + 1)) END AS text FROM i WHERE r = 1)"""


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 450)) AS s FROM w)
    SELECT doc_id, s // 450 AS chunk_id, array_to_string(w[s+1:s+500], ' ') AS chunk, len(w[s+1:s+500]) AS n_words FROM c WHERE len(w[s+1:s+500]) >= 50"""
)
def word_chunks(spark, sf_dir):
    return C.word_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS p FROM documents)
    SELECT doc_id, unnest(range(0, len(p))) AS chunk_id, unnest(p) AS chunk FROM s"""
)
def paragraph_chunks(spark, sf_dir):
    """Paragraphs stand on lines here."""
    return C.paragraph_chunks(table(spark, sf_dir, "documents"), "doc_id", mark="\n")


@query(
    """WITH d AS (SELECT doc_id, text, source AS h, 1000 - length(source) - 1 AS f FROM documents),
    s AS (SELECT *, unnest(CASE WHEN length(text) > f THEN list_concat([0], range(f, length(text), 1000)) ELSE [0] END) AS start FROM d),
    k AS (SELECT *, CASE WHEN start = 0 THEN 0 ELSE (start - f) // 1000 + 1 END AS k FROM s)
    SELECT doc_id, 'cs' || (k + 1) AS chunk_id, start, CASE WHEN k > 0 THEN '(continued from: ' || h || ')' || chr(10) ELSE '' END || substr(text, start + 1, CASE WHEN k = 0 THEN f ELSE 1000 END) AS chunk,
    length(substr(text, start + 1, CASE WHEN k = 0 THEN f ELSE 1000 END)) AS n_chars FROM k"""
)
def chunk_split_1000(spark, sf_dir):
    return C.split_chunks(table(spark, sf_dir, "documents"), "doc_id", heading="source")


@query(
    f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, span_no) AS k FROM spans),
    f AS (SELECT doc_id, k, length(text) AS total, 0 AS chunk_id FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, CASE WHEN f.total + length(o.text) > 1000 THEN length(o.text) ELSE f.total + length(o.text) END, CASE WHEN f.total + length(o.text) > 1000 THEN f.chunk_id + 1 ELSE f.chunk_id END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
    SELECT f.doc_id, chunk_id, string_agg(o.text, chr(10) ORDER BY o.k) AS chunk, count(*) AS n_parts, sum(length(o.text))::BIGINT AS n_chars FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k GROUP BY f.doc_id, chunk_id"""
)
def chunk_pack_1000(spark, sf_dir):
    s = pdf_spans(spark, sf_dir).withColumn("at", F.struct("page_no", "span_no"))
    return C.pack_parts(s, "doc_id", "at")


@query(
    f"""WITH {_SPANS}, n AS (SELECT *, sum(CASE WHEN starts_with(text, 'Section ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, span_no ROWS UNBOUNDED PRECEDING) AS section_id FROM spans)
    SELECT doc_id, section_id::BIGINT AS section_id, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_blocks FROM n GROUP BY doc_id, section_id"""
)
def sections_by_heading(spark, sf_dir):
    s = C.sections(pdf_spans(spark, sf_dir), "doc_id", ["page_no", "span_no"], F.col("text").startswith("Section "))
    return s.groupBy("doc_id", "section_id").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_blocks"))


_FONTS = f"""{_SPANS}, n AS (SELECT doc_id, size, sum(length(text)) AS n FROM spans GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY size) AS upto, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS r FROM n),
b AS (SELECT doc_id, max(CASE WHEN r = 1 THEN size END) AS body, max(size) AS title, min(size) AS least, min(CASE WHEN upto > total // 2 THEN size END) AS median FROM u GROUP BY doc_id),
a AS (SELECT n.*, b.title, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.n DESC, n.size) AS r, row_number() OVER (PARTITION BY n.doc_id, n.size < b.title ORDER BY n.n DESC, n.size) AS q FROM n JOIN b ON b.doc_id = n.doc_id WHERE n.size > b.body),
h AS (SELECT doc_id, max(CASE WHEN r = 1 THEN size END) AS h4, max(CASE WHEN q = 1 AND size < title THEN size END) AS under FROM a GROUP BY doc_id),
t AS (SELECT b.*, h.h4 AS top, CASE WHEN h.h4 IS NULL THEN body * 1.5::DOUBLE ELSE coalesce(under, title * 0.8::DOUBLE) END AS h1 FROM b LEFT JOIN h ON h.doc_id = b.doc_id),
fonts AS (SELECT doc_id, median, body, title, h1, CASE WHEN top IS NULL THEN body * 1.3::DOUBLE WHEN h1 > top THEN h1 - (h1 - top) / 3 ELSE top * 0.85::DOUBLE END AS h2,
  CASE WHEN top IS NULL THEN body * 1.2::DOUBLE WHEN h1 > top THEN top + (h1 - top) / 3 ELSE top * 0.7::DOUBLE END AS h3, coalesce(top, body * 1.1::DOUBLE) AS h4,
  CASE WHEN least < body THEN least ELSE body * 0.8::DOUBLE END AS subtext FROM t)"""


@query(f"WITH {_FONTS} SELECT doc_id, round(median, 6) AS median, round(body, 6) AS body, round(title, 6) AS title, round(h1, 6) AS h1, round(h2, 6) AS h2, round(h3, 6) AS h3, round(h4, 6) AS h4, round(subtext, 6) AS subtext FROM fonts")
def font_stats(spark, sf_dir):
    f = L.font_statistics(pdf_spans(spark, sf_dir))
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in f.columns[1:]])


_TOP = f"""{_SPANS}, c AS (SELECT doc_id, round_even(size * 4, 0) / 4 AS size, sum(length(text)) AS n FROM spans GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS rank FROM c)"""


@query(f"WITH {_TOP} SELECT doc_id, size, n::BIGINT AS n, rank, first_value(size) OVER (PARTITION BY doc_id ORDER BY rank) AS body FROM top WHERE rank <= 10")
def font_top10_body(spark, sf_dir):
    return L.top_sizes(pdf_spans(spark, sf_dir))


_TYPED = f"""{_TOP}, b AS (SELECT doc_id, size AS body FROM top WHERE rank = 1), s AS (SELECT p.*, round_even(p.size * 4, 0) / 4 AS g, b.body, t.rank FROM spans p JOIN b ON b.doc_id = p.doc_id LEFT JOIN top t ON t.doc_id = p.doc_id AND t.size = round_even(p.size * 4, 0) / 4 AND t.rank <= 10),
    y AS (SELECT *, max(CASE WHEN g > body AND rank IS NOT NULL AND length(trim(text)) >= 10 THEN g END) OVER (PARTITION BY doc_id) AS title FROM s),
    z AS (SELECT doc_id, page_no, span_no, text, size, CASE WHEN rank IS NULL THEN CASE WHEN abs(g - body) <= 0.5 THEN 'paragraph' ELSE 'subtext' END WHEN length(trim(text)) > 200 THEN 'paragraph'
      WHEN abs(g - title) < 0.01 AND length(trim(text)) >= 10 THEN 'title' WHEN abs(g - body) <= 0.25 THEN 'paragraph' WHEN g <= body - 1 THEN 'subtext'
      WHEN g > body AND g < title THEN CASE WHEN g > body + (title - body) * 0.75 THEN 'heading1' WHEN g > body + (title - body) * 0.5 THEN 'heading2' WHEN g > body + (title - body) * 0.25 THEN 'heading3' ELSE 'heading4' END
      ELSE 'paragraph' END AS type FROM y)"""


@query(f"WITH {_TYPED} SELECT doc_id, type, count(*) AS n FROM z GROUP BY ALL")
def block_types(spark, sf_dir):
    return L.classify(pdf_spans(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_TYPED}, l AS (SELECT *, type = 'title' OR starts_with(type, 'heading') AS head, lag(type = 'title' OR starts_with(type, 'heading')) OVER (PARTITION BY doc_id ORDER BY page_no, span_no) AS prev FROM z),
    isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR (head AND NOT prev) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, span_no ROWS UNBOUNDED PRECEDING) AS section_id FROM l),
    ch AS (SELECT doc_id, section_id, page_no, trim(string_agg(text, ' ' ORDER BY span_no)) AS text, sum(length(text))::INT AS n_chars FROM isl GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, page_no)::INT AS chunk_id, text, len({_WORDS.format(t='text')})::INT AS n_words, n_chars FROM ch"""
)
def pdf_nested_chunks(spark, sf_dir):
    """Documents nested as sections, chunks and blocks, and read back as a list of chunks."""
    return C.chunk_list(L.nested(L.classify(pdf_spans(spark, sf_dir))), "doc_id")


@query(
    f"""WITH {_TYPED}, l AS (SELECT *, type = 'title' OR starts_with(type, 'heading') AS head, lag(type = 'title' OR starts_with(type, 'heading')) OVER (PARTITION BY doc_id ORDER BY page_no, span_no) AS prev FROM z),
    isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR (head AND NOT prev) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, span_no ROWS UNBOUNDED PRECEDING) AS section_id FROM l),
    n AS (SELECT doc_id, count(DISTINCT section_id) AS n_sections, count(DISTINCT (section_id, page_no)) AS n_chunks, count(*) FILTER (WHERE head) AS n_headers FROM isl GROUP BY doc_id),
    t AS (SELECT doc_id, string_agg(type || '=' || k, ';' ORDER BY type) AS block_counts FROM (SELECT doc_id, type, count(*) AS k FROM z GROUP BY ALL) GROUP BY doc_id),
    q AS (SELECT doc_id, string_agg(size::VARCHAR || '=' || n, ';' ORDER BY rank) FILTER (WHERE rank <= 10) AS top_sizes, count(*) AS n_sizes, sum(n)::BIGINT AS n_chars FROM top GROUP BY doc_id)
    SELECT doc_id, n_sections::INT AS n_sections, n_chunks::INT AS n_chunks, n_headers::INT AS n_headers, block_counts, top_sizes, n_sizes, n_chars FROM n JOIN t USING (doc_id) JOIN q USING (doc_id)"""
)
def pdf_diagnostics(spark, sf_dir):
    """Sizes, types and structure of nested documents."""
    blocks = L.classify(pdf_spans(spark, sf_dir))
    content = L.nested(blocks).select(
        "doc_id", F.size("content").alias("n_sections"), F.size(F.flatten(F.transform("content", lambda s: s["chunks"]))).alias("n_chunks"), F.size(F.flatten(F.transform("content", lambda s: s["headers"]))).alias("n_headers"),
    )
    d = L.diagnostics(blocks)
    counts = F.array_join(F.transform(F.map_entries("block_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    sizes = F.array_join(F.transform("top_sizes", lambda x: F.concat(x["size"], F.lit("="), x["chars"])), ";")
    return content.join(d.select("doc_id", counts.alias("block_counts"), sizes.alias("top_sizes"), "n_sizes", "n_chars"), "doc_id")


@query(
    f"""WITH {_SPANS}, p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM spans GROUP BY doc_id),
    t AS (SELECT doc_id, lower(trim(text)) AS text, count(DISTINCT page_no) AS on_pages FROM spans WHERE length(trim(text)) >= 10 GROUP BY ALL)
    SELECT t.doc_id, t.text, on_pages, pages FROM t JOIN p ON p.doc_id = t.doc_id WHERE pages >= 5 AND on_pages >= floor(pages * 0.25)"""
)
def repeated_headers(spark, sf_dir):
    """Documents have at most seven pages here: limits are set lower."""
    return L.repeated_blocks(pdf_spans(spark, sf_dir), least_pages=5, share=0.25)


@query()
def chunks_merged_500(spark, sf_dir):
    packed = C.pack_parts(pdf_spans(spark, sf_dir).withColumn("at", F.struct("page_no", "span_no")), "doc_id", "at", most=300)
    return C.merge_chunks(packed, "doc_id", "chunk_id", least=500)


@query()
def span_blocks(spark, sf_dir):
    return L.merge_spans(pdf_spans(spark, sf_dir))


@query(
    f"""WITH {_FONTS}, k AS (SELECT s.*, CASE WHEN len(string_split(s.text, ' ')) > 20 THEN 2 WHEN s.size >= f.title THEN 0 WHEN s.size >= f.h1 OR s.size >= f.h2 OR s.size >= f.h3 OR s.size >= f.h4 THEN 1 ELSE 2 END AS k
    FROM spans s JOIN fonts f ON f.doc_id = s.doc_id WHERE s.page_no <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_no, span_no) AS r FROM k)
    SELECT doc_id, CASE WHEN k = 2 THEN substr(text, 1, 100) ELSE text END AS title FROM r WHERE r = 1"""
)
def pdf_titles(spark, sf_dir):
    return L.document_title(pdf_spans(spark, sf_dir))


_FINGERPRINT = "sha256(lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|' || lower(trim(p_type)) || '|' || p_size)"


@query(
    f"""WITH f AS (SELECT p_partkey AS pdf_id, {_FINGERPRINT} AS fingerprint FROM part)
    SELECT pdf_id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY pdf_id) > 1 AS duplicate, min(pdf_id) OVER (PARTITION BY fingerprint) AS first_id FROM f"""
)
def pdf_duplicates(spark, sf_dir):
    """Documents with the fingerprint of an earlier one. Only groups' smallest ids are joined back."""
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pdf_id"), L.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("fingerprint"))
    first = f.groupBy("fingerprint").agg(F.min("pdf_id").alias("first_id"))
    return f.join(first, "fingerprint").select("pdf_id", "fingerprint", (F.col("pdf_id") != F.col("first_id")).alias("duplicate"), "first_id")


