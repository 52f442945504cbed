"""Stored settings of older versions as columns: a chain of steps over a JSON object whose values keep their types (VARIANT)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The names that the newest version has.
VALID = (
    "enable_serper_cache", "enable_html_cache", "enable_fuzzy_cache_matching", "fuzzy_match_threshold", "serper_news_freshness_hours", "serper_search_freshness_hours", "serper_videos_freshness_hours", "serper_scholar_freshness_hours",
    "html_news_staleness_days", "html_blog_staleness_days", "html_product_staleness_days", "html_docs_staleness_days", "html_evergreen_staleness_days", "html_unknown_staleness_days", "revalidation_threshold_days", "error_cache_days", "filtered_cache_days", "max_cache_size_gb",
)


@dataclass(frozen=True)
class Step:
    """What brings settings to a version: names that go, new names (an old name's value wins), megabytes that become gigabytes (1 at least), the only names that stay, and values of names that are missing."""

    version: int
    drop: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    gigabytes: dict[str, str] = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)


#: The versions' names.
STEPS = (
    Step(1, drop=("serper_freshness_days", "enable_pdf_cache"), rename={"enable_processing_cache": "enable_html_cache"}),
    Step(2, rename={"recent_content_threshold_days": "revalidation_threshold_days"}, drop=("recent_news_revalidate_hours", "normal_revalidate_days")),
    Step(3, gigabytes={"max_cache_size_mb": "max_cache_size_gb"}, drop=("html_freshness_days", "pdf_freshness_days", "serper_freshness_hours")),
    Step(4, keep=VALID, defaults={"enable_html_cache": True, "revalidation_threshold_days": 15, "max_cache_size_gb": 100}),
)


def _variant(c: Column) -> Column:
    return c.cast("variant")


def _without(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def _put(m: Column, name: str, value: Column) -> Column:
    return F.map_concat(_without(m, name), F.create_map(F.lit(name), value))


def _stepped(m: Column, step: Step) -> Column:
    """The step's parts one after another; each takes the map as a variable, so that expressions don't repeat what stands before them."""
    has = lambda m, name: F.array_contains(F.map_keys(m), F.lit(name))
    if step.drop:
        m = _without(m, *step.drop)

    def renamed(old: str, new: str, value):
        return lambda m: F.when(has(m, old), _put(_without(m, old), new, value(F.element_at(m, old)))).otherwise(m)

    for old, new in step.rename.items():
        m = let(m, renamed(old, new, lambda v: v))
    for old, new in step.gigabytes.items():
        m = let(m, renamed(old, new, lambda v: _variant(F.greatest(F.lit(1).cast("bigint"), F.floor(F.try_variant_get(v, "$", "bigint") / 1024).cast("bigint")))))
    if step.keep:
        m = F.map_filter(m, lambda k, _: k.isin(*step.keep))
    if step.defaults:
        every = F.create_map(*[x for name, value in step.defaults.items() for x in (F.lit(name), _variant(F.lit(value)))])
        m = let(m, lambda m: F.map_concat(m, F.map_filter(every, lambda k, _: ~F.array_contains(F.map_keys(m), k))))
    return m


def migrated(settings: Column, version: Column, steps: tuple[Step, ...] = STEPS) -> Column:
    """Settings (a JSON object) of a version, as JSON of the newest one with names in order. No version is the oldest; what isn't an object becomes the defaults."""
    empty = F.expr("cast(map() as map<string, variant>)")
    m = F.coalesce(F.try_variant_get(F.try_parse_json(settings), "$", "map<string,variant>"), empty)
    for step in sorted(steps, key=lambda s: s.version):
        m = let(m, lambda m, step=step: F.when(F.coalesce(version, F.lit(0)) < step.version, _stepped(m, step)).otherwise(m))
    return F.to_json(F.to_variant_object(m))
