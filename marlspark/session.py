"""Session and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: All fixed points in time of the queries are relative to this one.
AS_OF = "2024-02-01 00:00:00"


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with what the operators rely on: UTC, AQE with skew joins. Cluster settings come from spark-submit."""
    b = SparkSession.builder.appName("marlspark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Query parameters that only track.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "ref", "source")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipeline, with the defaults that an application ships."""

    as_of: str = AS_OF
    tracking_params: tuple[str, ...] = TRACKING_PARAMS
    html_quality_threshold: int = 40
    legit_threshold: int = 70
    fuzzy_threshold: int = 98
    similarity_threshold: float = 0.7
    similarity_limit: int = 20
    reuse_days: float = 7
    skip_days: float = 15
    pdf_revalidate_days: int = 30
    queue_max_retries: int = 3
    queue_cleanup_days: float = 7
    chunk_words: int = 500
    chunk_step: int = 450
    chunk_least: int = 50
    chunk_chars: int = 1000
    staleness_days: dict[str, int] = field(default_factory=lambda: {"html": 7, "news": 7, "article": 30, "blog": 30, "docs": 30, "paper": 90, "pdf": 30})
    search_ttl_hours: dict[str, int] = field(default_factory=lambda: {"news": 6, "search": 24, "videos": 48, "scholar": 168})
