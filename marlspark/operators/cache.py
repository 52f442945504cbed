"""The content cache: pure functions from old state and a batch to new state, and decisions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days
from .ranking import top_per_key


def upsert_urls(old: DataFrame, batch: DataFrame) -> DataFrame:
    """url, first_seen, last_seen after a batch of (url, at)."""
    new = batch.select("url", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    return old.select("url", "first_seen", "last_seen").unionByName(new).groupBy("url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_results(old: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("query_id", "url")) -> DataFrame:
    """Search results by key: the last batch's position and title, the first engine. Rows have seq for their order."""
    both = old.unionByName(batch)
    return both.groupBy(*keys).agg(F.max_by("position", "seq").alias("position"), F.max_by("title", "seq").alias("title"), F.min_by("engine", "seq").alias("engine"), F.count(F.lit(1)).alias("n_seen"))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    return top_per_key(rows, [key], [F.col(at).desc(), F.col(tie).desc()])


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idempotent recording: the first row of each key stays."""
    return top_per_key(rows, keys, [F.col(order)])


def merge_dates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earliest publication and latest update of each URL; nulls don't count."""
    return old.unionByName(new).groupBy("url").agg(F.min("published_at").alias("published_at"), F.max("updated_at").alias("updated_at"))


def reuse_decision(last_hash: Column, new_hash: Column, analysed_hash: Column, same_versions: Column) -> Column:
    """Reuse the analysis, process the stored page again, or fetch."""
    return F.when(last_hash.isNull(), "refetch").when(new_hash.isNotNull() & (new_hash != last_hash), "refetch").when((analysed_hash == last_hash) & same_versions, "reuse-analysis").otherwise("reprocess-same-raw")


def simple_reuse(status: Column, processed: Column, as_of: Column, days: float = 7) -> Column:
    return F.when((status == "success") & (age_days(as_of, processed) < days), "reuse").otherwise("refetch")


def skip_decision(status: Column, processed: Column, as_of: Column, days: float = 15) -> Column:
    """Skips what failed or was filtered lately. An age of exactly zero counts as very old."""
    age = age_days(as_of, processed)
    age = F.when(age == 0, 999.0).otherwise(age)
    return F.when(status.isin("error", "failed") & (age < days), "skip-error").when((status == "filtered") & (age < days), "skip-filtered").otherwise("process")


def pdf_decision(download: Column, processing: Column, freshness: Column, download_failures: Column, processing_failures: Column, revalidate_after: Column, as_of: Column) -> Column:
    """Whether to download a document again, and why."""
    return (
        F.when(download.isNull(), "download:new")
        .when((processing == "failed") & (processing_failures < 2), "download:retry-processing")
        .when((download == "failed") & (download_failures < 3), "download:retry")
        .when((download == "failed") | (processing == "failed"), "skip:too-many-failures")
        .when((freshness == "stale") | (revalidate_after < as_of), "download:stale")
        .when((download == "success") & (processing == "success"), "skip:fresh")
        .otherwise("skip:in-progress")
    )


def fold_attempts(events: DataFrame, ok: str, bad: str) -> DataFrame:
    """Each URL's last outcome and its failures since the last success. Events have url, event, at, event_id."""
    e = events.filter(F.col("event").isin(ok, bad))
    order = F.struct("at", "event_id")
    last_ok = e.groupBy("url").agg(F.max(F.when(F.col("event") == ok, order)).alias("ok"), F.max_by("event", order).alias("last"), F.max("at").alias("at"))
    fails = e.filter(F.col("event") == bad).select("url", order.alias("o")).join(last_ok.select("url", "ok"), "url").groupBy("url").agg(F.count_if(F.col("ok").isNull() | (F.col("o") > F.col("ok"))).alias("failures"))
    return last_ok.join(fails, "url", "left").select("url", F.when(F.col("last") == ok, "success").otherwise("failed").alias("state"), F.coalesce("failures", F.lit(0)).alias("failures"), "at")


def typed_settings(settings: DataFrame) -> DataFrame:
    """(key, value, type) with the value in the column of its type; what can't be cast is null."""
    v, t = F.col("value"), F.col("type")
    return settings.select(
        "key", F.when(t == "int", v.try_cast("bigint")).alias("int_value"), F.when(t == "float", v.try_cast("double")).alias("float_value"),
        F.when(t == "bool", F.lower(v).isin("true", "1", "yes")).alias("bool_value"), F.when(t.isin("string", "json"), v).alias("string_value"),
    )


def migrate(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """Old rows under a newer schema: added columns are null."""
    return wanted.limit(0).unionByName(old, allowMissingColumns=True).select(*wanted.columns)


def purge(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def cached_search(asked: DataFrame, cached: DataFrame, as_of: Column, hours: Column) -> DataFrame:
    """Each asked (id, query, settings) with the latest cached search (query_id, query, settings, at) of the same text and settings within its time to live."""
    c = cached.withColumnRenamed("settings", "s").withColumnRenamed("query", "q")
    hit = asked.join(c, (F.col("query") == F.col("q")) & (F.col("settings") == F.col("s")) & (age_days(as_of, F.col("at")) * 24 <= hours))
    return hit.groupBy("id").agg(F.max(F.struct("at", "query_id"))["query_id"].alias("query_id"))


def start_searches(asked: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append for asked (query_id, query, settings: map): the query normalised, the settings as JSON with sorted keys."""
    from ..functions.text import normalize_query

    return asked.select("query_id", normalize_query(F.col("query")).alias("query"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("settings")))).alias("settings"), as_of.alias("at"))


def save_analyses(searches: DataFrame, analyses: DataFrame) -> DataFrame:
    """searches with the analysis of those in analyses (query_id, analysis, n_analysed); the rest keep what they have."""
    new = analyses.select("query_id", F.col("analysis").alias("_a"), F.col("n_analysed").alias("_n"))
    j = searches.join(new, "query_id", "left")
    keep = [c for c in searches.columns if c not in ("analysis", "n_analysed")]
    return j.select(*keep, F.coalesce("_a", "analysis").alias("analysis"), F.coalesce("_n", "n_analysed").alias("n_analysed"))


def record_fetches(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """The fetch history (url, content_hash, fetched_at, n_bytes) with fetched (url, html, fetched_at) behind it."""
    from ..functions.text import html_content_hash

    new = fetched.select("url", html_content_hash(F.col("html")).alias("content_hash"), "fetched_at", F.octet_length(F.coalesce("html", F.lit(""))).alias("n_bytes"))
    return store.unionByName(new)


def cached_analyses(fetches: DataFrame, analyses: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Of each URL the newest analysis of its newest content by the same versions: fetches (url, content_hash, fetched_at), analyses (url, content_hash, created_at, analysis_id and a column for each version)."""
    now = fetches.groupBy("url").agg(F.max_by("content_hash", F.struct("fetched_at", "content_hash")).alias("content_hash"))
    same = analyses
    for name, value in versions.items():
        same = same.filter(F.col(name) == value)
    hit = same.join(now, ["url", "content_hash"])
    return hit.groupBy("url", "content_hash").agg(F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("analysis_id"))


def latest_decisions(urls: DataFrame, processed: DataFrame, as_of: Column) -> DataFrame:
    """What to do with urls that were processed (url, status, processed_at, proc_id): the decision over the latest row. A URL without any has none."""
    last = processed.groupBy("url").agg(F.max_by(F.struct("status", "processed_at"), F.struct("processed_at", "proc_id")).alias("l"))
    return urls.join(last, "url").select("url", "l.status", "l.processed_at", skip_decision(F.col("l.status"), F.col("l.processed_at"), as_of).alias("decision"))


def look_up(asked: DataFrame, cached: DataFrame, as_of: Column, ttl_hours: Column, threshold: float = 98) -> DataFrame:
    """id, query_id, score: the exact hit of an asked query within its time to live; for the rest the best fuzzy one."""
    from .fuzzy import best_matches

    exact = cached_search(asked, cached, as_of, ttl_hours).select("id", "query_id", F.lit(100).alias("score"))
    fresh = cached.filter(age_days(as_of, F.col("at")) * 24 <= ttl_hours)
    rest = asked.join(exact.select("id"), "id", "left_anti")
    fuzzy = best_matches(rest.select("id", "query"), fresh.select(F.col("query_id").alias("id"), "query"), threshold)
    return exact.unionByName(fuzzy.select("id", F.col("match_id").alias("query_id"), "score"))


def quality_scores(rows: DataFrame) -> DataFrame:
    """The fields of stored scores (proc_id, scores: JSON, content): missing ones are 0, words are counted where none are stored, and a class follows from the score."""
    s = F.from_json("scores", "heuristic_score int, nlp_score int, final_score int, word_count int, quality_class string")
    n = F.coalesce("s.word_count", F.lit(0))
    counted = F.size(F.filter(F.split("content", r"(?U)\s+"), lambda w: w != ""))
    zero = lambda c: F.coalesce(f"s.{c}", F.lit(0))
    score = zero("final_score")
    own = F.when(score >= 70, "legit").when(score >= 40, "maybe").otherwise("skip")
    return rows.withColumn("s", s).select(
        "proc_id", zero("heuristic_score").alias("heuristic_score"), zero("nlp_score").alias("nlp_score"), score.alias("final_score"),
        F.when((n == 0) & (F.col("content") != ""), counted).otherwise(n).alias("word_count"), F.coalesce(F.nullif("s.quality_class", F.lit("")), own).alias("quality_class"),
    )


def merge_by_index(cached: DataFrame, processed: DataFrame) -> DataFrame:
    """Results that were cached and those that were processed, without heavy columns, in the order they were asked in."""
    heavy = ("full_extraction", "document", "pages", "chunks")
    return cached.drop(*heavy).unionByName(processed.drop(*heavy), allowMissingColumns=True).orderBy("index")


def mark_staleness(urls: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """urls (url, published_at, cache_state, revalidate_after) after marks (url, cache_state, revalidate_after): without a time of its own, a mark holds for a day where the page is younger than 30 days, else for a week."""
    from ..functions.dates import revalidate_after

    new = marks.select("url", F.col("cache_state").alias("_s"), F.col("revalidate_after").alias("_r"), F.lit(True).alias("_marked"))
    j = urls.join(new, "url", "left")
    at = F.when(F.col("_marked"), F.coalesce("_r", revalidate_after(F.col("published_at"), as_of))).otherwise(F.col("revalidate_after"))
    return j.select("url", "published_at", F.when(F.col("_marked"), F.col("_s")).otherwise(F.col("cache_state")).alias("cache_state"), at.alias("revalidate_after"))


def pdf_records(attempts: DataFrame, texts: DataFrame, most_failures: int = 2, preview: int = 1000, days: int = 30) -> DataFrame:
    """Of each URL with processing attempts (url, event: complete or fail, at, event_id, error): flags, preview, next validation, failures.

    texts: url, text. A success keeps the first `preview` characters and is valid for `days`; a failure keeps the last error and
    leaves what a success before it had extracted.
    """
    folded = fold_attempts(attempts, "complete", "fail")
    order = F.struct("at", "event_id")
    ok, bad = F.col("event") == "complete", F.col("event") == "fail"
    last = attempts.groupBy("url").agg(F.max(F.when(ok, F.col("at"))).alias("extracted_at"), F.max_by("error", F.when(bad, order)).alias("error"))
    j = folded.join(last, "url").join(texts, "url", "left")
    had, good = F.col("extracted_at").isNotNull(), F.col("state") == "success"
    return j.select(
        "url", had.alias("extracted"), good.alias("processed"), "failures", (~good & (F.col("failures") >= most_failures)).alias("given_up"),
        F.when(~good, F.col("error")).alias("error"), F.when(had, F.substring("text", 1, preview)).alias("preview"), F.when(had, F.length("text")).alias("n_chars"),
        F.when(good, F.timestamp_add("DAY", F.lit(days), F.col("at"))).alias("revalidate_after"),
    )


def failed_records(records: DataFrame, n: int | None = None) -> DataFrame:
    """Records whose last attempt failed, most failures first. Equal numbers go by url."""
    found = records.filter(~F.col("processed")).orderBy(F.col("failures").desc(), "url")
    return found if n is None else found.limit(n)
