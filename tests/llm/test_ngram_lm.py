import math
from collections import Counter

import numpy as np
import pytest

from marlspark.llm import ngram_lm as L


@pytest.mark.parametrize(("n", "bound"), [(0, 1), (1, 1), (1, 2**61), (5, 10), (1000, 1200), (1000, 10**6), (20000, 2**58), (5000, 5001), (300, 64)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, bound, n, dtype=np.uint64))
    e = L.EliasFano.build(x, bound)
    e = L.EliasFano.of(L.load(np.frombuffer(L.dump(e.arrays("q")), np.uint8)), "q")
    assert (e.get(np.arange(n)) == x).all()
    q = np.r_[x, rng.integers(0, bound, 500, dtype=np.uint64), np.uint64(0), np.uint64(bound - 1)]
    rank, equal = e.seek(q)
    assert (rank == np.searchsorted(x, q)).all() and (equal == np.isin(q, x)).all()


def test_query_equals_brute_force(docs, remainder):
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in docs.collect()]
    train = [w for i, w in rows if remainder(i, 7) != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in train for p in zip(["^", *w], w))
    context = Counter(c)
    context["^"] = len(train)
    kept = {p: k for p, k in pairs.items() if k >= L.LEAST}
    mass = Counter()
    for (u, _), k in kept.items():
        mass[u] += k
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    got = {r.doc_id: r for r in L.query(docs).collect()}
    for i, w in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, remainder(i, 7) == 2)
        base = sum(math.log10(p1(x)) for x in w)
        want = 0.0
        for u, x in zip(["^", *w], w):
            left = (L.K + context[u] - mass[u]) * p1(x)
            want += math.log10((kept.get((u, x), 0) + left) / (context[u] + L.K)) if context[u] else math.log10(p1(x))
        assert abs(base - r.base_score) < 1e-9 * max(1, abs(base))
        # probabilities are quantised
        assert abs(want - r.score) < 3e-4 * len(w)


def test_pairs_seen_once_count(spark):
    df = spark.createDataFrame([(0, "salt pepper"), (1, "salt water"), (3, "cold pepper")], "doc_id bigint, text string")
    model = L.fit(df)
    got = {r.doc_id: r.score for r in L.score(df, model).collect()}
    n, v, k = 9, 5, L.K
    p1 = {"salt": 3 / (n + v + 1), "pepper": 3 / (n + v + 1), None: 4 / (n + v + 1)}
    # counts: after the start mark salt 2 of 3, after salt pepper 1 of 2, after pepper the end 2 of 2
    want = sum(math.log10((c + k * p1[w]) / (u + k)) for c, u, w in ((2, 3, "salt"), (1, 2, "pepper"), (2, 2, None)))
    assert abs(got[0] - want) < 1e-3


def test_odd_rows(odd, empty):
    rows = L.query(odd).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert L.query(empty).count() == 0
    assert L.score(odd, L.fit(empty)).filter("base_score <> 0 OR score <> 0 OR n_known <> 0").count() == 0


def test_a_lost_shard_fails(docs, monkeypatch):
    """A shard of pairs that is gone before the trie is built is an error, not a model without its pairs."""
    import glob
    import os

    gather, path, folders = L._gather, L.fresh_path, []

    class Loses:
        def __init__(self, df):
            self.df = df

        def collect(self):
            rows = self.df.collect()
            files = glob.glob(f"{L.Files(folders[-1]).root}/kept-*")
            assert files
            os.remove(files[0])
            return rows

    monkeypatch.setattr(L, "fresh_path", lambda spark, name: folders.append(path(spark, name)) or folders[-1])
    monkeypatch.setattr(L, "_gather", lambda df, build, schema, n: Loses(gather(df, build, schema, n)) if "held" in schema else gather(df, build, schema, n))
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        L.fit(docs)
