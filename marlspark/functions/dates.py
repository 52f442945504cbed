"""Dates, ages and freshness decisions as column expressions. `as_of` stands for now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Patterns of visible dates; names of meta tags with a date.
BYLINE_PATTERNS = (
    r"Published[\s:]+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
    r"Published[\s:]+(\d{1,2}\s+[A-Z][a-z]+\s+\d{4})",
    r"Updated[\s:]+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
    r"Updated[\s:]+(\d{1,2}\s+[A-Z][a-z]+\s+\d{4})",
    r"(\d{4}-\d{2}-\d{2})",
)
PUBLISHED_NAMES = ("article:published_time", "og:published_time", "datePublished", "sailthru.date", "article.published", "published_date")
MODIFIED_NAMES = ("article:modified_time", "og:updated_time", "dateModified", "article.updated", "last_modified")
_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy")


def age_days(as_of: Column, t: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / F.lit(8.64e10)


def parse_date(s: Column) -> Column:
    """A timestamp from ISO or written dates; null if none fits. What gives the text is evaluated once, however many formats are tried."""

    def tried(v: Column) -> Column:
        written = F.initcap(F.regexp_replace(v, r"\s+", " "))
        # a format that doesn't fit costs an exception: only those that begin as the text does are tried
        begins = lambda w: ((_FORMATS[:1], w.rlike("^[+-]?[0-9]+-")), (_FORMATS[3:4] + _FORMATS[6:], w.rlike("^[+-]?[0-9]+ ")), (_FORMATS[1:3] + _FORMATS[4:6], w.rlike("^[^0-9]")))
        found = let(written, lambda w: F.coalesce(*[F.when(fits, F.coalesce(*[F.try_to_timestamp(w, F.lit(f)) for f in formats])) for formats, fits in begins(w)]))
        return F.when(v.isNotNull(), F.coalesce(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(v)), found))

    return let(s, tried)


def byline_found(text: Column) -> Column:
    """Every date in visible text as (at, near): what the pattern matches with 20 characters before and after, lower-cased."""
    none = F.array().cast("array<struct<at: timestamp, near: string>>")

    def matches(p: str) -> Column:
        # what stands around a match is looked at, not taken: it may hold the next one; behind is only looked where the pattern matches
        plain = p.replace("(", "(?:", 1)
        around = f"(?is)(?={plain})(?<=(^.{{0,19}}|.{{20}}))(?:{p})(?=(.{{0,20}}))"
        before, own, date, after = (F.regexp_extract_all(text, F.lit(around), F.lit(i)) for i in (1, 0, 2, 3))
        every = F.arrays_zip(before.alias("before"), own.alias("own"), date.alias("date"), after.alias("after"))
        found = F.transform(every, lambda m: F.struct(parse_date(m["date"]).alias("at"), F.lower(F.concat(m["before"], m["own"], m["after"])).alias("near")))
        return F.when(text.isNull() | text.rlike(f"(?is){plain}"), found).otherwise(none)

    return F.filter(F.concat(*map(matches, BYLINE_PATTERNS)), lambda d: d["at"].isNotNull())


def _published_updated(found: Column) -> tuple[Column, Column]:
    new = lambda d: F.contains(d["near"], F.lit("updated")) | F.contains(d["near"], F.lit("modified"))
    return F.transform(F.filter(found, lambda d: ~new(d)), lambda d: d["at"]), F.transform(F.filter(found, new), lambda d: d["at"])


def byline_dates(text: Column) -> tuple[Column, Column]:
    """Arrays of published and updated dates in visible text.

    A date with `updated` or `modified` within 20 characters of the pattern's
    match, or in it, is an update.
    """
    return _published_updated(byline_found(text))


def json_ld(html: Column) -> Column:
    """Bodies of the page's JSON-LD scripts, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def json_ld_items(html: Column) -> Column:
    """All items of all the page's JSON-LD scripts, in order, as variants. What isn't JSON has none."""
    parsed = F.filter(F.transform(json_ld(html), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def json_ld_dates(html: Column) -> tuple[Column, Column]:
    """Published and updated by JSON-LD: of the items' own dates the last; the first of a graph only where no item has one."""
    items = json_ld_items(F.when(F.contains(F.lower(html), F.lit("ld+json")), html))
    graphs = F.flatten(F.filter(F.transform(items, lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")), lambda g: g.isNotNull()))

    def found(name: str) -> Column:
        dates = lambda of: F.filter(F.transform(of, lambda v: parse_date(F.try_variant_get(v, f"$.{name}", "string"))), lambda d: d.isNotNull())
        return F.coalesce(F.try_element_at(dates(items), F.lit(-1)), F.get(dates(graphs), 0))

    return found("datePublished"), found("dateModified")


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, whichever comes first in a tag; null if there's none."""
    n = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:property|name|itemprop)=["']{n}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name|itemprop)=["']{n}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def meta_dates(html: Column) -> tuple[Column, Column]:
    """Published and updated by meta tags, the first name that has a date; then `<time itemprop>`."""
    tag = lambda p: F.nullif(F.regexp_extract(html, rf"""(?is)<time[^>]*itemprop=["']{p}["'][^>]*datetime=["']([^"']*)["']""", 1), F.lit(""))
    published = F.coalesce(*[parse_date(meta_content(html, n)) for n in PUBLISHED_NAMES], parse_date(tag("datePublished")))
    updated = F.coalesce(*[parse_date(meta_content(html, n)) for n in MODIFIED_NAMES], parse_date(tag("dateModified")))
    return published, updated


def detect_dates(html: Column, text: Column, http_last_modified: Column, sitemap_lastmod: Column) -> Column:
    """published, updated and where each is from: JSON-LD, meta tags, byline, HTTP, sitemap; the earliest publication and latest update within a source."""
    jp, ju = json_ld_dates(html)
    mp, mu = meta_dates(html)
    byline = let(byline_found(text), lambda v: F.struct(*[f(x).alias(n) for f, x, n in zip((F.array_min, F.array_max), _published_updated(v), ("bp", "bu"), strict=True)]))
    source = lambda *c: F.coalesce(*[F.when(x.isNotNull(), n) for n, x in c], F.lit("none"))

    def merged(d: Column) -> Column:
        bp, bu = d["byline"]["bp"], d["byline"]["bu"]
        return F.struct(
            F.coalesce(d["jp"], d["mp"], bp).alias("published"),
            source(("jsonld", d["jp"]), ("og", d["mp"]), ("byline", bp)).alias("published_source"),
            F.coalesce(d["ju"], d["mu"], bu, http_last_modified, sitemap_lastmod).alias("updated"),
            source(("jsonld", d["ju"]), ("og", d["mu"]), ("byline", bu), ("http_last_modified", http_last_modified), ("sitemap", sitemap_lastmod)).alias("updated_source"),
        )

    found = F.struct(jp.alias("jp"), ju.alias("ju"), mp.alias("mp"), mu.alias("mu"), byline.alias("byline"))
    return let(found, merged)


def pdf_date(raw: Column) -> Column:
    """Year, month and day of `D:YYYYMMDD...`, without a calendar check; null if it isn't one."""
    p = r"^(?:D:)?(\d{4})(\d{2})(\d{2})"
    part = lambda i: F.regexp_extract(raw, p, i)
    return F.when(raw.rlike(p), F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day")))


def freshness(status: Column, old_tag: Column, new_tag: Column, old_modified: Column, new_modified: Column, fetched: Column, updated: Column, published: Column, kind: Column, days: dict[str, int], as_of: Column) -> Column:
    """(is_fresh, reason): validators, then the page's own update, then age by type, then the content's age."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), kind), F.lit(7))
    rule = lambda ok, why: F.struct(F.lit(ok).alias("is_fresh"), F.lit(why).alias("reason"))
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    return (
        F.when(status == 304, rule(True, "not_modified"))
        .when(both(old_tag, new_tag) & (old_tag == new_tag), rule(True, "etag_match"))
        .when(both(old_tag, new_tag), rule(False, "etag_changed"))
        .when(both(old_modified, new_modified) & (old_modified == new_modified), rule(True, "last_modified_match"))
        .when(both(updated, fetched) & (updated > fetched), rule(False, "content_updated"))
        .when(fetched.isNull(), rule(False, "never_fetched"))
        .when(age_days(as_of, fetched) < limit, rule(True, "within_staleness"))
        .when(both(published, fetched) & (age_days(as_of, F.coalesce(updated, published)) > 365), rule(True, "old_content"))
        .otherwise(rule(False, "stale"))
    )


def revalidate_after(published: Column, as_of: Column) -> Column:
    """A day later for what is younger than 30 days, else a week."""
    young = F.coalesce(age_days(as_of, published) < 30, F.lit(False))
    return F.when(young, as_of + F.expr("INTERVAL 24 HOURS")).otherwise(as_of + F.expr("INTERVAL 7 DAYS"))
