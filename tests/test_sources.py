"""Search results as a data source, documents as files, sitemaps and feeds, and search by many vectors."""

import json
import os
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspark.functions.urls import short_hash
from marlspark.operators import vectors
from marlspark.sources import feeds, files, serp


@pytest.fixture()
def answers(tmp_path):
    for i in range(4):
        rows = [{"query": f"q{i % 2}", "organic": [{"link": f"http://a/{i}", "title": "t", "snippet": "s"}, {"title": "none"}], "news": [{"url": f"http://n/{i}", "body": "b"}]}]
        (tmp_path / f"a{i}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
        os.utime(tmp_path / f"a{i}.jsonl", (1000 + i, 1000 + i))
    return tmp_path


def test_filters_are_pushed_and_columns_chosen(spark, answers):
    spark.dataSource.register(serp.SerpSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("serp").option("push", "true").load(f"{answers}/*.jsonl")
        some = load().filter("kind = 'news' AND query IN ('q1', 'q7') AND position = 0")
        assert sorted(r.link for r in some.collect()) == ["http://n/1", "http://n/3"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        left = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
        assert left and not any("kind#" in line or "q1" in line for line in left)  # Spark is left with the position, and whether a query is null
        assert load().filter("kind = 'videos' AND kind = 'news'").count() == 0 and load().count() == 8
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    two = spark.read.format("serp").schema("link string, position int").load(f"{answers}/*.jsonl")
    assert two.columns == ["link", "position"] and {r.link for r in two.collect()} == {f"http://{k}/{i}" for k in "an" for i in range(4)}
    reader = serp.SerpSource({"path": f"{answers}/*.jsonl"}).reader(two.schema)
    assert [b.schema.names for b in reader.read(reader.partitions()[0])] == [["link", "position"]]


def test_new_files_are_streamed_once(spark, answers):
    spark.dataSource.register(serp.SerpSource)
    seen = []

    def run():
        q = spark.readStream.format("serp").load(f"{answers}/*.jsonl").writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.link for r in b.collect()))).option("checkpointLocation", f"{answers}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    assert sum(seen, []) == sorted(f"http://{k}/{i}" for k in "an" for i in range(4))
    (answers / "new.jsonl").write_text(json.dumps({"query": "q", "organic": [{"link": "http://new"}]}))
    seen.clear()
    run()
    assert sum(seen, []) == ["http://new"]


def test_documents_are_written_whole_or_not(spark, tmp_path):
    spark.dataSource.register(files.DocumentSink)
    rows = spark.createDataFrame([(f"http://x/{i}", json.dumps({"i": i})) for i in range(9)], "url string, document string").repartition(3)

    def save(df):
        df.write.format("documents").option("kind", "raw").mode("append").save(str(tmp_path))

    bad = rows.withColumn("document", F.when(F.col("url") == "http://x/5", F.raise_error(F.lit("broken"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="broken"):
        save(bad)
    assert os.listdir(tmp_path) == []
    save(rows)
    want = {f"{r[0]}_raw.json" for r in rows.select(short_hash(F.col("url"))).collect()}
    assert set(os.listdir(tmp_path)) == want
    save(rows)
    assert set(os.listdir(tmp_path)) == want


def test_feeds(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss/a.xml").write_text(
        """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><link>http://site</link>
        <item><link> http://s/1/ </link><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate></item><item><guid>http://s/2</guid><pubDate>03 Jan 2024 01:00 +0100</pubDate><dc:date>2024-02-01T00:00:00Z</dc:date></item>
        <item><link>http://s/3</link><pubDate>soon</pubDate></item><item><guid>17</guid><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"""
    )
    (tmp_path / "atom.xml").write_text(
        """<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="http://no"/><link rel="alternate" href="http://s/1"/><published>2024-01-01T00:00:00Z</published><updated>2024-01-05T00:00:00+02:00</updated></entry>
        <entry><link href="http://s/4"/><published>2023-12-31T10:00:00Z</published></entry><entry><title>none</title></entry></feed>"""
    )
    (tmp_path / "map.xml").write_text("""<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://s/4/</loc><lastmod>2024-03</lastmod></url><url><loc>http://s/5</loc></url></urlset>""")
    (tmp_path / "index.xml").write_text("""<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>http://s/m1.xml</loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><loc>http://s/m2.xml</loc></sitemap></sitemapindex>""")
    t = lambda *x: datetime(*x)
    rss = {r.url: r.modified_at for r in feeds.rss_entries(spark, str(tmp_path / "rss")).collect()}
    assert rss == {"http://s/1/": t(2024, 1, 2, 3, 4, 5), "http://s/2": t(2024, 2, 1)}
    atom = {r.url: r.modified_at for r in feeds.atom_entries(spark, str(tmp_path / "atom.xml")).collect()}
    assert atom == {"http://s/1": t(2024, 1, 4, 22), "http://s/4": t(2023, 12, 31, 10)}
    every = feeds.rss_entries(spark, str(tmp_path / "rss")).unionByName(feeds.atom_entries(spark, str(tmp_path / "atom.xml"))).unionByName(feeds.sitemap_entries(spark, str(tmp_path / "map.xml")))
    pages = spark.createDataFrame([("http://s/1",), ("http://s/2/",), ("http://s/4",), ("http://s/5",)], "url string")
    assert {r.url: r.modified_at for r in feeds.page_dates(pages, every).collect()} == {"http://s/1": t(2024, 1, 4, 22), "http://s/2/": t(2024, 2, 1), "http://s/4": t(2024, 3, 1), "http://s/5": None}
    index = str(tmp_path / "index.xml")
    assert feeds.sitemap_index(spark, index).count() == 2 and [r.url for r in feeds.sitemap_index(spark, index, F.lit("2024-01-02").cast("timestamp")).collect()] == ["http://s/m2.xml"]
    assert [r[0] for r in spark.createDataFrame([("Mon, 1 Jan 2024 00:00:00 +0000",), ("2024",), ("1 Foo 2024 00:00:00 GMT",), (None,)], "s string").coalesce(1).select(feeds.feed_time(F.col("s"))).collect()] == [t(2024, 1, 1), t(2024, 1, 1), None, None]


def test_many_queries_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(5)]) for i in range(300)] + [(900, None), (901, [0.0] * 5)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(5)
    queries = chunks.filter("chunk_id % 7 = 0 OR chunk_id = 901").withColumnRenamed("chunk_id", "query_id")
    m = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v}
    for threshold, block in ((None, 8), (0.5, 512)):
        want = []
        for q in m:
            if q % 7 == 0 or q == 901:
                s = sorted((-round(float(m[q] @ m[c]), 6), c) for c in m if c != q)
                want += [(q, c, -x + 0.0, i) for i, (x, c) in enumerate([y for y in s if threshold is None or -y[0] >= threshold][:6], 1)]
        got = [(r.query_id, r.chunk_id, round(r.similarity, 6) + 0.0, r["rank"]) for r in vectors.search_many(queries, chunks, 6, threshold, block).collect()]
        assert sorted(got) == sorted(want)
    assert vectors.search_many(queries.limit(0), chunks).count() == 0
