"""The 0-100 rubric for pages and documents: every signal is a column expression of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WIRES, sentences, wire_hits, word_count, words

#: The rubric's patterns and names.
CLICKBAIT = (r"you won't believe", "shocking", "what happened next", "this is why", r"number \d+ will shock you", "doctors hate")
HEADLINES = (r"you won't believe", "shocking", "what happened next", r"number \d+ will", "doctors hate", r"\d+ tricks", "this one weird")
ROUNDUP = (r"top \d+", r"\d+ things", r"\d+ ways", r"\d+ reasons", "roundup", r"best of \d{4}", "what you need to know")
AFFILIATE = ("/go/", "ref=", "utm_", "aff_", "affiliate", "track=")
TRUSTED = (".edu", "stanford.edu", "mit.edu", "harvard.edu", "berkeley.edu", "reuters.com", "bloomberg.com", "bbc.com", "theguardian.com", "nature.com", "science.org", "arxiv.org")
SUSPICIOUS = (r"\d{4,}", "cheap", "deals", "buy", "discount", "-ads", "promo")
PDF_TIERS = (
    (20, (".gov", ".mil", "whitehouse.gov", "un.org", "worldbank.org", "imf.org", "nber.org")),
    (15, (".edu", "arxiv.org", "nature.com", "science.org", "microsoft.com", "mckinsey.com", "stanford.edu", "mit.edu")),
    (8, ("reuters.com", "bloomberg.com", "bbc.com", ".org")),
)
NEWS_WORDS = ("news", "post", "times", "journal", "tribune", "herald", "gazette", "daily")
SPAM_WORDS = ("promo", "deals", "buy", "shop", "discount", "cheap")


def any_of(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def any_match(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def length_points(n: Column) -> Column:
    return F.when((n >= 600) & (n <= 4500), 12).when((n > 4500) & (n <= 20000), 5).when((n < 250) | (n > 20000), -10).otherwise(0)


def quote_points(t: Column) -> Column:
    """Share of sentences with a quote mark between 3 and 30 per cent."""
    s = sentences(t)
    share = F.size(F.filter(s, lambda x: F.contains(x, F.lit('"')) | F.contains(x, F.lit("'")))) / F.size(s)
    return F.when((F.size(s) > 0) & (share >= 0.03) & (share <= 0.3), 5).otherwise(0)


def wire_points(t: Column) -> Column:
    return F.when(wire_hits(t, WIRES) == 0, 8).otherwise(0)


def capitalised(head: Column) -> Column:
    """Words after the first of a stretch that begin with a capital and have three characters or more."""
    return F.size(F.filter(words(head), lambda w, i: (i > 0) & (F.length(w) > 2) & w.rlike(r"^\p{Lu}")))


def entity_points(t: Column) -> Column:
    return F.when(capitalised(F.substring_index(F.substring(t, 1, 200), "\n\n", 1)) >= 2, 5).otherwise(0)


def roundup_points(title: Column) -> Column:
    marks = F.length(title) - F.length(F.translate(title, "•|", ""))
    return F.when(any_match(title, ROUNDUP) | (marks > 2), -5).otherwise(0)


def link_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href="))


def affiliate_count(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))
    return F.size(F.filter(found, lambda u: any_of(u, AFFILIATE)))


def main_region(html: Column) -> Column:
    """The first article, main or body element, else the whole page."""
    pick = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[\s>].*?</{tag}>", 0), F.lit(""))
    return F.coalesce(pick("article"), pick("main"), pick("body"), html)


def link_points(region: Column, n_words: Column) -> Column:
    blocks = F.greatest(F.lit(1), F.floor(n_words / 300))
    return F.when((link_count(region) > 50) | (affiliate_count(region) / blocks > 2), -6).otherwise(0)


def pagination_points(url: Column, html: Column) -> Column:
    paged = F.contains(url, F.lit("page=")) | F.contains(url, F.lit("/page/"))
    return F.when(paged & ~html.rlike(r"""(?i)<link[^>]*rel=["']next["']"""), -5).otherwise(0)


def clickbait_points(title: Column) -> Column:
    return F.when(any_match(title, CLICKBAIT), -3).otherwise(0)


def domain_points(netloc: Column) -> Column:
    low = F.lower(netloc)
    return F.when(any_of(low, TRUSTED), 5).when(any_match(low, SUSPICIOUS), -4).otherwise(0)


def page_type_points(path: Column, n_articles: Column, has_schema: Column, n_words: Column, n_links: Column) -> Column:
    """Home pages, lists of articles, and thin pages of links."""
    return F.when(path.isin("", "/"), -20).when((n_articles >= 3) & ~has_schema, -15).when((n_words < 400) & (n_links > 10), -10).otherwise(0)


def ellipsis_points(t: Column) -> Column:
    """Cut-off teasers: the share of longer lines that end in dots."""
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    share = F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))) / F.size(lines)
    return F.when(F.size(lines) < 3, 0).when(share > 0.3, -15).when(share > 0.15, -8).otherwise(0)


def schema_points(html: Column, article: Column) -> Column:
    """An article by JSON-LD, else by OpenGraph."""
    from .dates import meta_content

    return F.when(article, 20).when(F.contains(F.lower(meta_content(html, "og:type")), F.lit("article")), 15).otherwise(0)


def is_article(items: Column) -> Column:
    """Of a page's JSON-LD items one of an article type, in any script."""
    return F.exists(items, lambda v: F.coalesce(F.contains(F.try_variant_get(v, "$['@type']", "string"), F.lit("Article")), F.lit(False)))


def element(html: Column, tags: tuple[str, ...], attribute: str, value: str) -> Column:
    """The first of these elements with an attribute that matches. Project it, so that a page is searched once for each attribute."""
    mark = rf"""(?:\s|\s[^>]*\s){attribute}=["'](?:{value})["'][^>]*>"""
    return F.regexp_extract(html, "(?is)" + "|".join(f"<{t}{mark}" + ("" if t == "meta" else f".*?</{t}>") for t in tags), 0)


def element_value(found: Column, *first: str) -> Column:
    """Of an element: the first attribute of `first` and content that isn't empty, else its text."""
    of = lambda a: F.nullif(F.trim(F.regexp_extract(found, rf"""(?is)^<[^>]*\s{a}=["']([^"']*)["']""", 1)), F.lit(""))
    inner = F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return F.coalesce(*[of(a) for a in (*first, "content")], inner)


#: Where authors and dates stand in pages, as (attribute, pattern of its value), in order.
AUTHORS = (("class", "[^\"']*(?:author|byline|writer)[^\"']*"), ("rel", "author"), ("itemprop", "author"), ("name", "author"))
#: Of each of these patterns words in lower case of which a page that it matches has one.
AUTHOR_WORDS = (("author", "byline", "writer"), ("author",), ("author",), ("author",))
DATE_WORDS = (("datepublished",), ("published_time",), ("published_time",), ("publishdate",), ("date", "time", "publish"))
DATES = (("itemprop", "datePublished"), ("property", "article:published_time"), ("name", "article:published_time"), ("name", "publishdate"), ("class", "[^\"']*(?:date|time|publish)[^\"']*"))


def _elements(html: Column, low: Column, tags: tuple[str, ...], places: tuple, hints: tuple) -> list[Column]:
    """Only a page with one of a pattern's words (in `low`, the page in lower case) is searched by it."""
    return [F.when(any_of(low, some), element(html, tags, attribute, value)).otherwise("") for (attribute, value), some in zip(places, hints, strict=True)]


def byline_elements(html: Column, low: Column) -> list[Column]:
    return _elements(html, low, ("span", "div", "p", "a", "meta"), AUTHORS, AUTHOR_WORDS)


def date_elements(html: Column, low: Column) -> list[Column]:
    return _elements(html, low, ("time", "span", "div", "meta"), DATES, DATE_WORDS)


def named_points(authors: list[Column]) -> Column:
    """An author of two words or more, one of them capitalised, among elements' values."""

    def named(author: Column) -> Column:
        w = words(author)
        return (F.size(w) >= 2) & F.exists(w, lambda x: x.rlike(r"^\p{Lu}"))

    hit = F.lit(False)
    for author in authors:
        hit = hit | named(author)
    return F.when(hit, 10).otherwise(0)


def dated_points(dates: list[Column], as_of: Column) -> Column:
    """A date not older than two years among elements' values: ISO before a T, else the first ten characters by the usual formats."""
    since, hit = as_of - F.expr("INTERVAL 730 DAYS"), F.lit(False)
    for raw in dates:
        iso = F.try_to_timestamp(F.substring_index(raw, "T", 1), F.lit("yyyy-MM-dd"))
        written = F.coalesce(*[F.try_to_timestamp(F.substring(raw, 1, 10), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "d MMMM yyyy", "yyyy")])
        hit = hit | F.coalesce(F.when(F.contains(raw, F.lit("T")), iso).otherwise(written) >= since, F.lit(False))
    return F.when(hit, 10).otherwise(0)


def byline_points(html: Column) -> Column:
    """named_points of a page's elements, in one expression."""
    return named_points([element_value(e) for e in byline_elements(html, F.lower(html))])


def recent_points(html: Column, as_of: Column) -> Column:
    """dated_points of a page's elements, in one expression."""
    return dated_points([element_value(e, "datetime") for e in date_elements(html, F.lower(html))], as_of)


def canonical_points(canonical_host: Column, own_host: Column) -> Column:
    return F.when((canonical_host != "") & (canonical_host == own_host), 8).otherwise(0)


def class_of(score: Column, low: str = "skip") -> Column:
    return F.when(score >= 70, "legit").when(score >= 40, "maybe").otherwise(low)


def pdf_domain_points(domain: Column) -> Column:
    low, out = F.lower(domain), None
    for points, parts in PDF_TIERS:
        hit = any_of(low, parts)
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.otherwise(0)


def pdf_domain_points_v1(domain: Column) -> Column:
    """The older tiers: 15, 10, 5."""
    return F.when(pdf_domain_points(domain) == 20, 15).when(pdf_domain_points(domain) == 15, 10).when(pdf_domain_points(domain) == 8, 5).otherwise(0)


def pdf_length_points_v1(n: Column) -> Column:
    return F.when((n >= 600) & (n <= 10000), 12).when((n >= 300) & (n < 600), 8).when(n > 10000, 4).when(n < 100, -10).otherwise(2)


def pdf_metadata_points(title: Column, author: Column, subject: Column, keywords: Column) -> Column:
    has = lambda c, n: F.length(F.trim(F.coalesce(c, F.lit("")))) >= n
    return F.when(has(title, 4), 5).otherwise(0) + F.when(has(author, 3), 5).otherwise(0) + F.when(has(subject, 1), 3).otherwise(0) + F.when(has(keywords, 1), 2).otherwise(0)


def pdf_words_points(n: Column) -> Column:
    return F.when(n >= 600, 19).when(n >= 300, 8).otherwise(0)


def pdf_structure_points(headings: Column) -> Column:
    return F.when(headings >= 3, 18).when(headings >= 1, 9).otherwise(0)


def pdf_density_points(n_words: Column, pages: Column) -> Column:
    d = n_words / F.greatest(pages, F.lit(1))
    return F.when((d >= 210) & (d <= 490), 10).when(((d >= 190) & (d < 210)) | ((d > 490) & (d <= 510)), 6).when(((d >= 100) & (d < 190)) | ((d > 510) & (d <= 800)), 4).otherwise(0)


def pdf_entity_points(t: Column) -> Column:
    return F.when(capitalised(F.substring(t, 1, 500)) >= 2, 6).otherwise(0)


def pdf_recent_points(raw: Column, as_of: Column) -> Column:
    """`D:` and 14 digits, else ISO, not older than two years."""
    at = F.when(raw.startswith("D:"), F.try_to_timestamp(F.substring(raw, 3, 14), F.lit("yyyyMMddHHmmss"))).otherwise(F.try_to_timestamp(raw))
    return F.when(at >= as_of - F.expr("INTERVAL 730 DAYS"), 12).otherwise(0)


def syllables(t: Column) -> Column:
    """Groups of vowels over all words: a heuristic, not a dictionary's count."""
    return F.aggregate(words(F.lower(t)), F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouyàâäéèêëíìîïóòôöúùûüá]+"))))


def difficult_words(t: Column) -> Column:
    """Words of three syllables or more."""
    return F.size(F.filter(words(F.lower(t)), lambda w: F.regexp_count(w, F.lit("[aeiouyàâäéèêëíìîïóòôöúùûüá]+")) >= 3))


def readability(t: Column) -> dict[str, Column]:
    """Counts and the usual formulas."""
    w, s, y, d = word_count(t), F.greatest(F.size(sentences(t)), F.lit(1)), syllables(t), difficult_words(t)
    chars = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    return {
        "words": w,
        "sentences": s,
        "syllables": y,
        "difficult": d,
        "flesch": F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (y / w),
        "grade": F.lit(0.39) * (w / s) + F.lit(11.8) * (y / w) - F.lit(15.59),
        "ari": F.lit(4.71) * (chars / w) + F.lit(0.5) * (w / s) - F.lit(21.43),
        "fog": F.lit(0.4) * ((w / s) + F.lit(100.0) * (d / w)),
    }


def flesch_band(x: Column) -> Column:
    return (
        F.when(x >= 90, "very_easy").when(x >= 80, "easy").when(x >= 70, "fairly_easy").when(x >= 60, "standard").when(x >= 50, "fairly_difficult").when(x >= 30, "difficult").otherwise("very_difficult")
    )


def nlp_score(jsonld: Column, opengraph: Column, article: Column, news: Column, spam: Column, caps: Column, clickbait: Column, marks: Column, flesch: Column, wire: Column, lexicon: Column) -> Column:
    """The second rubric, from 50."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    readable = F.when((flesch >= 30) & (flesch <= 80), 10).when((flesch < 30) & (lexicon > 3000), 5).when(flesch < 30, -5).otherwise(0)
    size = F.when(lexicon > 5000, 20).when(lexicon > 2000, 15).when(lexicon > 1000, 10).when(lexicon > 300, 5).otherwise(0)
    return clamp(50 + add(jsonld, 15) + add(opengraph, 5) + add(article, 10) + add(news, 10) + add(spam, -15) + add(caps, -10) - 5 * clickbait + add(marks > 2, -5) + readable + add(wire, -10) + size)


def headline_hits(title: Column) -> Column:
    """How many of the second rubric's headline patterns a title has."""
    return sum((F.lower(title).rlike(p).cast("int") for p in HEADLINES), F.lit(0))


def blend(heuristic: Column, nlp: Column) -> Column:
    """Weighted 7 to 3 and truncated."""
    return (heuristic * F.lit(0.7) + nlp * F.lit(0.3)).cast("int")
