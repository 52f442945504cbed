import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb

from marlspark.llm import importance as I
from marlspark.llm.common import pick


def brute(docs, target):
    """Every number from its definition, one text after another."""

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    of = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    rows = []
    for i, n, f in of:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(long[: 25 * len(long) // 100], 1)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows)


def test_equals_brute_force(spark, docs):
    more = spark.createDataFrame([(-1, "Ünïcode Words ﷽ 日本語 🤗 and\x00nul [ok] {x} A_B " * 5), (None, "some text of many words " * 6), (None, "some text of many words " * 6), (0, None), (-2, ""), (-3, "lone")], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    target = spark.createDataFrame([("Words and words of the target text 日本語",), (None,), ("the end of it",)], "text string")
    got = Counter(map(tuple, I.query(every, target).collect()))
    assert got == brute([tuple(r) for r in every.collect()], [r.text for r in target.collect()])


def test_equals_sql(spark, sf, docs):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = I.query(docs, target)
    assert Counter(map(tuple, found.collect())) == Counter(db.sql(I.ORACLE_SQL).select(", ".join(found.columns)).fetchall())


def test_draw_has_the_texts(spark, docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got, ranks = I.resampled(docs, target).collect(), {r["rank"]: r.doc_id for r in I.query(docs, target).collect() if r["rank"]}
    assert {r["rank"]: r.doc_id for r in got} == ranks and sorted(ranks) == list(range(1, len(ranks) + 1)) and all(len(r.text.split()) > 10 for r in got)


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(None,)], "text string")
    rows = I.query(odd, target).collect()
    assert len(rows) == odd.count() and {r.n_features for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert Counter(map(tuple, rows)) == brute([tuple(r) for r in pick(odd, "doc_id", "text").collect()], [])
    assert I.query(empty, target).count() == 0
