"""Versions of the store, domains' methods, batches, stored settings."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlspark.functions import settings as S
from marlspark.operators import cache, chunking, methods
from marlspark.sources.versions import Conflict, Versions, purged

T0 = datetime(2024, 1, 1)


def test_versions_are_whole_or_absent(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    assert store.open().number == 0 and list(store.open()) == []
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, s string")
    first = store.publish({"parent": a, "child": a.select(F.col("id").alias("parent_id"), (F.col("id") * 10).alias("id"))})
    held = store.open()
    second = store.publish(purged(held, {"parent": [("child", "parent_id", "id")]}, "parent", a.filter("id = 1"), "id"), held)
    assert [r.id for r in store.open()["parent"].collect()] == [2] and [r.parent_id for r in store.open()["child"].collect()] == [2]
    assert first["parent"].count() == held["child"].count() == 2  # who reads goes on reading
    with pytest.raises(Conflict):
        store.publish({"parent": a}, held)  # another was faster
    assert store.numbers() == [1, 2] and store.open().number == second.number

    def breaks(_):
        raise ValueError("no")

    bad = a.rdd.map(breaks).toDF("id bigint, s string")
    with pytest.raises(Exception, match="no"):
        store.publish({"parent": a, "child": bad})
    assert store.numbers() == [1, 2]  # nothing of a change that fails is seen
    assert store.publish({"more": a}).number == 3 and sorted(store.open()) == ["child", "more", "parent"]


def test_purge_reaches_children_of_children(spark):
    rows = {"a": [(1,), (2,), (3,)], "b": [(10, 1), (20, 2), (30, None)], "c": [(5, 10), (6, 20), (7, None)]}
    t = {"a": spark.createDataFrame(rows["a"], "id bigint"), "b": spark.createDataFrame(rows["b"], "id bigint, a bigint"), "c": spark.createDataFrame(rows["c"], "id bigint, b bigint")}
    out = purged(t, {"a": [("b", "a", "id")], "b": [("c", "b", "id")]}, "a", t["a"].filter("id <> 2"), "id")
    assert [sorted(r.id for r in out[n].collect()) for n in "abc"] == [[2], [20, 30], [6, 7]]


def test_methods_equal_a_plain_loop(spark):
    rng = random.Random(5)
    attempts = [(f"d{rng.randrange(6)}", rng.choice(["requests", "requests", "browser"]), rng.random() < 0.45, rng.choice(["timeout", "bot"]), T0 + timedelta(minutes=rng.randrange(300)), i) for i in range(250)]
    manual = [("d1", "browser", "ann", T0 + timedelta(minutes=50)), ("d1", "auto", "ann", T0 + timedelta(minutes=100)), ("d2", "requests", None, T0 + timedelta(minutes=10)), ("d9", "browser", "bob", T0)]
    want = {}
    for d in {a[0] for a in attempts} | {m[0] for m in manual}:
        resets = [m[3] for m in manual if m[0] == d and m[1] == "auto"]
        streak, switch = 0, None
        for _, _, ok, reason, at, i in sorted((a for a in attempts if a[0] == d and a[1] == "requests"), key=lambda a: (a[4], a[5])):
            streak = 0 if ok else streak + 1
            if streak >= 3 and switch is None and (not resets or at > max(resets)):
                switch = (at, reason)
        chosen = [m for m in manual if m[0] == d]
        last = max(chosen, key=lambda m: m[3]) if chosen else None
        held = last[1] if last and last[1] != "auto" else None
        want[d] = (held or ("browser" if switch else "auto"), held or ("browser" if switch else "requests"), f"manual:{last[2] or ''}" if held else switch and switch[1], switch and switch[0])
    a, m = spark.createDataFrame(attempts, "domain string, method string, success boolean, reason string, at timestamp, attempt_id bigint"), spark.createDataFrame(manual, "domain string, method string, user string, at timestamp")
    got = {r.domain: (r.preferred, r.next_method, r.reason, r.switched_at) for r in methods.preferences(a, m).collect()}
    assert got == want and any(w[3] for w in want.values())


def test_batches(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice([None, 1, 40, 90, 300])) for d in range(7) for i in range(rng.randrange(40))]
    got = {(r.doc, r.i): r.batch_no for r in chunking.batches(spark.createDataFrame(rows, "doc bigint, i int, n int"), "doc", "i", "n", 5, 200).collect()}
    want = {}
    for d in range(7):
        batch, items, total = 0, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == d):
            if items and (items >= 5 or total + (n or 0) > 200):
                batch, items, total = batch + 1, 0, 0
            items, total = items + 1, total + (n or 0)
            want[d, i] = batch
    assert got == want
    assert chunking.batches(spark.createDataFrame([], "doc string, i int, n int"), "doc", "i", "n").count() == 0


def test_settings_of_any_version(spark):
    rows = [
        ('{"enable_processing_cache": false, "enable_html_cache": true, "max_cache_size_mb": 100, "x": [1]}', None),
        ('{"recent_content_threshold_days": 3.5, "error_cache_days": "text"}', 1),
        ('{"max_cache_size_mb": 9000, "recent_content_threshold_days": 3}', 2),
        ('{"anything": {"a": 1}}', 4), ("not json", 0), (None, 0),
    ]
    got = [json.loads(r[0]) for r in spark.createDataFrame(rows, "s string, v int").coalesce(1).select(S.migrated(F.col("s"), F.col("v"))).collect()]
    default = {"enable_html_cache": True, "revalidation_threshold_days": 15, "max_cache_size_gb": 100}
    assert got == [default | {"enable_html_cache": False, "max_cache_size_gb": 1}, default | {"revalidation_threshold_days": 3.5, "error_cache_days": "text"}, default | {"max_cache_size_gb": 8}, {"anything": {"a": 1}}, default, default]


def test_processing_records(spark):
    at = lambda n: T0 + timedelta(days=n)
    rows = [("a", "fail", at(1), 1, "e1"), ("a", "complete", at(2), 2, None), ("b", "complete", at(1), 3, None), ("b", "fail", at(2), 4, "e4"), ("b", "fail", at(3), 5, "e5"), ("c", "fail", at(1), 6, None)]
    records = cache.pdf_records(spark.createDataFrame(rows, "url string, event string, at timestamp, event_id bigint, error string"), spark.createDataFrame([("a", "x" * 1500), ("b", "short")], "url string, text string"))
    r = {x.url: x for x in records.collect()}
    assert (len(r["a"].preview), r["a"].n_chars, r["a"].processed, r["a"].failures, r["a"].revalidate_after) == (1000, 1500, True, 0, at(32))
    assert (r["b"].preview, r["b"].extracted, r["b"].processed, r["b"].failures, r["b"].given_up, r["b"].error) == ("short", True, False, 2, True, "e5")
    assert (r["c"].extracted, r["c"].given_up, r["c"].preview) == (False, False, None)
    assert [x.url for x in cache.failed_records(records).collect()] == ["b", "c"]


def test_domains_by_rules(spark, tmp_path):
    from marlspark.operators import domains

    (tmp_path / "rules.dat").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\n\nblog.co.uk // private\n*.compute.example\n")
    rules = domains.rules(spark, str(tmp_path / "rules.dat"))
    want = {
        "a.b.com": ("com", "b.com"), "com": ("com", "com"), "x.co.uk": ("co.uk", "x.co.uk"), "y.z.blog.co.uk": ("blog.co.uk", "z.blog.co.uk"), "blog.co.uk": ("blog.co.uk", "blog.co.uk"), "a.b.c.ck": ("c.ck", "b.c.ck"), "c.ck": ("c.ck", "c.ck"),
        "www.ck": ("ck", "www.ck"), "q.www.ck": ("ck", "www.ck"), "a.unknown": ("unknown", "a.unknown"), "localhost": ("localhost", "localhost"), "10.0.0.1": (None, "10.0.0.1"), "A.B.Com.": ("com", "b.com"), "n.eu.compute.example": ("eu.compute.example", "n.eu.compute.example"),
    }
    hosts = spark.createDataFrame([(h,) for h in want] * 2 + [(None,)], "host string")
    assert {r.host: (r.public_suffix, r.domain) for r in domains.registrable(hosts, rules).collect()} == want
    assert domains.registrable(hosts, rules.limit(0)).filter("host = 'x.co.uk' AND domain = 'co.uk'").count() == 1


def test_nested_documents_and_diagnostics(spark):
    from marlspark.operators import layout

    rows = [(1, 1, 1, "title", 20.0, "T"), (1, 1, 2, "paragraph", 10.0, "one"), (1, 2, 3, "paragraph", 10.1, "two"), (1, 2, 4, "heading1", 14.0, "H"), (1, 2, 5, "heading2", 12.0, "I"), (1, 3, 6, "subtext", 8.0, "three"), (1, 3, 7, "header_footer", 8.0, "9"), (2, 1, 1, "paragraph", 10.0, "lone")]
    b = spark.createDataFrame(rows, "doc_id bigint, page_no bigint, span_no bigint, type string, size double, text string")
    n = {r.doc_id: r.content for r in layout.nested(b).collect()}
    assert [(s.section_id, s.headers, [(c.chunk_id, c.page_no, c.char_count, [x.text for x in c.blocks]) for c in s.chunks]) for s in n[1]] == [
        (1, ["T"], [(1, 1, 4, ["T", "one"]), (2, 2, 3, ["two"])]), (2, ["H", "I"], [(3, 2, 2, ["H", "I"]), (4, 3, 5, ["three"])]),
    ]
    assert [(s.headers, len(s.chunks)) for s in n[2]] == [([], 1)]
    assert [(r.chunk_id, r.text) for r in chunking.chunk_list(layout.nested(b), "doc_id").filter("doc_id = 1").orderBy("chunk_id").collect()] == [(1, "T one"), (2, "two"), (3, "H I"), (4, "three")]
    d = {r.doc_id: r for r in layout.diagnostics(b, 2).collect()}
    assert [(x.size, x.chars) for x in d[1].top_sizes] == [(8.0, 6), (10.0, 6)] and d[1].block_counts == {"title": 1, "paragraph": 2, "heading1": 1, "heading2": 1, "subtext": 1, "header_footer": 1} and d[1].n_sizes == 5
