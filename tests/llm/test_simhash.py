import numpy as np
import xxhash
from pyspark.sql import functions as F

from marlspark.llm import simhash as S


def brute_print(text, size=4):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(w)] if 0 < len(w) < size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, threshold=4):
    """The smallest position that each print reaches."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_query_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components(prints)
    got = {r.doc_id: r for r in S.query(docs).collect()}
    for r, p, c in zip(rows, prints, want, strict=True):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == rows[c].doc_id


def test_hash_is_sparks(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_chains_and_full_anchors(spark):
    rng = np.random.default_rng(5)
    prints = {0, 3}
    for b in rng.integers(0, 2**63, 25):
        x = int(b)
        for _ in range(rng.integers(1, 25)):
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            prints.add(x % 2**64)
    prints = sorted(prints)
    want = brute_components(prints)
    points = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(prints)], "print bigint, node bigint")
    for blocks, homes in ((3, 8192), (2, 8192), (3, 3)):
        found = {r.node: r.component for r in S.components(S.links(points, 4, blocks, homes)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == want


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(6)
    for code in S.coverings(3, 4):
        x = rng.integers(0, 2**63, 200).astype(np.uint64)
        y = x ^ np.uint64(1 << (code.low + int(rng.integers(code.width))))
        homes = [set(a[h].tolist()) for a, h in [code.anchors(x[i : i + 1])[1:] for i in range(200)]]
        reach = [set(code.anchors(y[i : i + 1])[1].tolist()) for i in range(200)]
        assert all(len(h) == 1 and h <= r for h, r in zip(homes, reach, strict=True))


def test_odd_rows(odd, empty):
    got = S.query(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.fingerprint == "0" * 16 for r in got if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in got if r.doc_id == 5} == {5}
    assert S.query(empty).count() == 0
