"""Operators over small tables, and the registered queries' contract."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlspark.operators import cache, chunking, layout, queue, ranking, vectors
from marlspark.sources import files, serp
from marlspark.streaming import queue as stream_queue
from marlspark.streaming import windows

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert entry.entry(spark).count() > 0


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    got = chunking.word_chunks(spark.createDataFrame([(1, text), (2, "few words")], "k int, text string"), "k").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.n_words) for r in got] == [(0, 500), (1, 500), (2, 100)] and got[1].chunk.startswith("w450 ")
    rng = random.Random(1)
    for size in (0, 1, 999, 1000, 1001, 3500):
        t = "".join(rng.choice("ab ") for _ in range(size))
        rows = chunking.split_chunks(spark.createDataFrame([(1, t, "Head")], "k int, text string, h string"), "k", heading="h").orderBy("start").collect()
        assert "".join(r.chunk.split("\n", 1)[1] if r.chunk.startswith("(continued") else r.chunk for r in rows) == t
        assert max(r.n_chars for r in rows) <= 1000


def test_packing_and_merging(spark):
    df = spark.createDataFrame([([400, 500, 200, 900, 50, 2000, 10],)], "s array<int>")
    r = df.select(chunking.chunk_numbers(F.col("s")).alias("p"), chunking.merge_small(F.col("s")).alias("m")).first()
    assert r.p == [0, 0, 1, 2, 2, 3, 4] and r.m == [0, 0, 1, 1, 2, 2, 2]


def test_span_merging(spark):
    rows = [(1, 1, 1, "Title of the", 20.0), (1, 1, 2, "Report", 20.0), (1, 1, 3, "Body text that ends in the", 10.0), (1, 1, 4, "Middle of it.", 12.0), (1, 1, 5, "7", 10.0), (1, 1, 6, "More body text here to weigh a lot and then more", 10.0)]
    got = layout.merge_spans(spark.createDataFrame(rows, "doc_id bigint, page_no bigint, span_no bigint, text string, size double")).orderBy("block_no").collect()
    assert [r.text for r in got] == ["Title of the Report", "Body text that ends in the Middle of it. More body text here to weigh a lot and then more"]


def test_ranking(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = ranking.global_rank(df, [F.col("v").desc()]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: -r.v)] == list(range(1, 1001))


def test_vectors(spark):
    df = spark.createDataFrame([("a", "html", 1, [1.0, 0.0]), ("a", "html", 2, [0.0, 0.0]), ("b", "pdf", 3, [1.0, 1.0])], "url string, doc_type string, chunk_id int, embedding array<float>")
    got = vectors.search(df, [2.0, 0.0], 5).collect()
    assert [(r.chunk_id, r.similarity) for r in got] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    assert vectors.search(df, [2.0, 0.0], 5, urls=df.filter("url = 'none'").select("url")).count() == 0


def _events(n=400, seed=3):
    rng = random.Random(seed)
    return [(i, f"u{rng.randrange(9)}", rng.choice(["enqueue", "start", "complete", "fail", "touch"]), datetime(2024, 1, 1) + timedelta(minutes=i), 1.0) for i in range(n)]


def _folded(rows, retries=3):
    out = {}
    for _, url, event, at, _ in rows:
        now = stream_queue.advance(out.get(url), event, at, retries)
        if now:
            out[url] = now
    return out


def test_queue_in_batch(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "event_id bigint, url string, event string, at timestamp, value double")
    got = {r.url: r for r in queue.queue_state(df).collect()}
    for url, (status, retries, added, _) in _folded(rows).items():
        assert (got[url].retry_count, got[url].added_at) == (retries, added)
        assert got[url].status == status
    s = queue.queue_stats(queue.queue_state(df))
    assert {r.status for r in s.collect()} == set(queue.STATES)


def test_queue_and_windows_on_a_stream(spark, tmp_path):
    rows = _events()
    schema = "event_id bigint, url string, event string, at timestamp, value double"
    df = spark.createDataFrame(rows, schema)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    found = {}

    def sink(batch, _):
        found.update({r.url: r for r in batch.collect()})

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream_queue.run_available(stream_queue.queue_updates(stream), sink, str(tmp_path / "c1")).awaitTermination(120)
    assert {u: (r.status, r.retry_count) for u, r in found.items()} == {u: v[:2] for u, v in _folded(rows).items()}
    q = windows.tumbling(stream, "1 hour", delay="0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() == windows.tumbling(df, "1 hour").count()


EVENT = "event_id bigint, url string, event string, at timestamp, doc_type string"


def _streamed(spark, tmp_path, batches, **conf):
    """The batches of a stream's updates, one file of events each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = []
    stream_queue.run_available(stream_queue.queue_updates(stream, **conf), lambda batch, _: seen.append(batch.collect()), str(tmp_path / "c")).awaitTermination(200)
    return seen


def test_stream_takes_events_in_their_own_order(spark, tmp_path):
    """Events shuffled over five batches end as the batch fold has them."""
    rows = [(i, url, event, at, "pdf") for i, url, event, at, _ in _events(300)]
    mixed = rows[:]
    random.Random(7).shuffle(mixed)
    seen = _streamed(spark, tmp_path, [mixed[i::5] for i in range(5)], delay="30 days")
    last = {r.url: (r.status, r.retry_count, r.added_at, r.updated_at) for batch in seen for r in batch}
    assert last == _folded([(i, url, event, at, 0) for i, url, event, at, _ in rows])


def test_stream_puts_back_and_forgets(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [
        [(1, "a", "enqueue", day(0), "pdf"), (2, "a", "start", day(0.1), "pdf"), (3, "b", "enqueue", day(0), "html"), (4, "b", "complete", day(0.2), "html")],
        [(5, "c", "enqueue", day(2), None)],
        [(6, "c", "touch", day(20), None)],
        [(7, "b", "enqueue", day(40), "html")],
    ]
    seen = [r for batch in _streamed(spark, tmp_path, batches, delay="1 hour", stuck_hours=6, keep_days=7) for r in batch]
    of = lambda url: [r.status for r in seen if r.url == url]
    assert of("a")[0] == "processing" and of("a")[-1] == "pending" and [r.updated_at for r in seen if r.url == "a"][-1] == day(0.1) + timedelta(hours=6)
    assert "expired" in of("b") and of("b")[-1] == "pending" and [r.added_at for r in seen if r.url == "b"][-1] == day(40)
    taken = {}
    last = stream_queue.newest(spark.createDataFrame([r for r in seen], stream_queue.OUTPUT))
    stream_queue.dispatch(last, {k: lambda df, k=k: taken.update({k: sorted(r.url for r in df.collect())}) for k in ("pdf", "html")})
    assert taken == {"pdf": ["a", "c"], "html": ["b"]}


def test_cache_rules(spark):
    one = spark.range(1)
    lit = lambda v: F.lit(v).cast("string")
    got = one.select(
        cache.reuse_decision(lit(None), lit(None), lit(None), F.lit(True)), cache.reuse_decision(lit("h"), lit("x"), lit("h"), F.lit(True)), cache.reuse_decision(lit("h"), lit("h"), lit("h"), F.lit(True)), cache.reuse_decision(lit("h"), lit(None), lit("h"), F.lit(False)),
    ).first()
    assert tuple(got) == ("refetch", "refetch", "reuse-analysis", "reprocess-same-raw")
    old = spark.createDataFrame([("u", 1)], "url string, a int")
    assert cache.migrate(old, spark.createDataFrame([], "url string, a int, b string")).first().b is None
    s = spark.createDataFrame([("a", "7", "int"), ("b", "x", "int"), ("c", "YES", "bool"), ("d", "1.5", "float")], "key string, value string, type string")
    t = {r.key: r for r in cache.typed_settings(s).collect()}
    assert t["a"].int_value == 7 and t["b"].int_value is None and t["c"].bool_value and t["d"].float_value == 1.5


def test_merges_do_not_depend_on_order(spark):
    a = spark.createDataFrame([("u", datetime(2024, 1, 2)), ("v", datetime(2024, 1, 1))], "url string, at timestamp")
    b = spark.createDataFrame([("u", datetime(2024, 1, 1))], "url string, at timestamp")
    none = a.limit(0).select("url", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    ab, ba = (cache.upsert_urls(cache.upsert_urls(none, x), y).orderBy("url").collect() for x, y in ((a, b), (b, a)))
    assert ab == ba and ab[0].first_seen.day == 1 and ab[0].last_seen.day == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"query": "q", "organic": [{"link": "http://a", "title": "A"}], "scholar": [{"link": "http://s"}]}) + "\n")
    spark.dataSource.register(serp.SerpSource)
    rows = spark.read.format("serp").load(str(tmp_path / "*.jsonl")).collect()
    assert {(r.kind, r.link) for r in rows} == {("organic", "http://a"), ("scholar", "http://s")}
    assert spark.read.format("serp").option("provider", "ddg").load(str(tmp_path / "*.jsonl")).count() == 1
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "y.pdf").write_bytes(b"<html>")
    got = {r.path.rsplit("/")[-1]: r.p for r in files.pdf_files(spark, str(tmp_path)).select("path", files.pdf_problem(F.col("length"), F.col("content")).alias("p")).collect()}
    assert got == {"x.pdf": None, "y.pdf": "no PDF header"}


def test_partitions_do_not_matter(spark):
    q = entry.queries()
    for name in ("font_stats", "queue_state", "pages_ranked"):
        rows = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(str, q[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert rows[0] == rows[1]




def test_stored_results_equal_the_data_source(spark, tmp_path):
    rows = [{"query": "a", "organic": [{"link": "u", "title": "t", "snippet": "s"}, {"title": "no link"}, {"href": "h", "body": "b"}], "videos": [{"url": "v"}]}, {"query": None, "news": None}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    spark.dataSource.register(serp.SerpSource)
    for name in ("serper", "ddg"):
        want = spark.read.format("serp").option("provider", name).load(f"{tmp_path}/*.jsonl").collect()
        assert sorted(map(str, serp.stored_results(spark, f"{tmp_path}/*.jsonl", name).collect())) == sorted(map(str, want)) and len(want) == 3


def test_packing_of_many_parts(spark):
    assert chunking.packed([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3] and chunking.merged([5, 5, 5, 20, 1], 10) == [0, 0, 1, 1, 1]
    got = spark.range(1).select(chunking.chunk_numbers(F.array_repeat(F.lit(7), 50000), 70).alias("c")).first().c
    assert got == [i // 10 for i in range(50000)]


def test_content_similarity_by_hand(spark):
    from math import log, sqrt

    from marlspark.operators import similarity

    df = spark.createDataFrame([("red fish red fish blue", "blue fish bird"), ("the of", "a b"), ("same words here", "same words here")], "a string, b string")
    got = [r.s for r in df.select(similarity.tfidf_cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    x = log(1.5) + 1
    want = (2 * 1 + 1 * 1) / (sqrt((2 * x) ** 2 + 2**2 + 1) * sqrt(1 + 1 + x * x))
    assert abs(got[0] - want) < 1e-9 and got[1] == 0 and abs(got[2] - 1) < 1e-9


def test_blocks_of_pages_and_merged_chunks(spark):
    from marlspark.functions import html

    page = "<title>T</title><h1>Head</h1><p>One <b>two</b><p>three</p><nav><p>no</p></nav><ul><li>item</ul><script>x</script>"
    f = html.parse(page)
    assert [(b["type"], b["level"], b["text"]) for b in f["blocks"]] == [("heading", 1, "Head"), ("p", 0, "One two"), ("p", 0, "three"), ("li", 0, "item")]
    parts = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((100, 450, 600, 20, 30))], "doc int, at int, chunk string")
    m = sorted((r.chunk_id, r.merged_from, r.n_chars) for r in chunking.merge_chunks(parts, "doc", "at", least=500).collect())
    assert m == [(0, [0, 1], 550), (1, [2, 3, 4], 650)]


def test_analysis_pipeline_decides_by_the_store(spark):
    q = entry.queries()["analysis_pipeline"](spark, SF).collect()
    assert len({r.url for r in q}) == len(q) and {r.decision for r in q} == {"reuse", "refetch"}
    assert all(r.decision == "refetch" for r in q if r.status != "success")


def test_similarity_of_many_terms_takes_no_product_of_them(spark):
    from time import time

    from marlspark.operators import similarity

    text = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([(text, text + " more")] * 200, "a string, b string")
    start = time()
    assert {round(r.s, 6) for r in df.select(similarity.tfidf_cosine(F.col("a"), F.col("b")).alias("s")).collect()} and time() - start < 30
    assert spark.createDataFrame([(None, "x")], "a string, b string").select(similarity.tfidf_cosine(F.col("a"), F.col("b")).alias("s")).first().s is None


def test_pages_are_merged_without_a_frame_each(spark):
    """Many small pages: a pandas frame for each costs more than its work."""
    rows = spark.range(60).selectExpr("id AS doc_id", "1L AS page_no", "explode(array(2L, 1L)) AS span_no").selectExpr("*", "concat('text ', span_no) AS text", "9D AS size")
    out = layout.merge_spans(rows)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert len(got) == 60 and {(r.block_no, r.text) for r in got} == {(0, "text 1 text 2")}
