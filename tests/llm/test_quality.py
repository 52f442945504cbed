import math
import re

import numpy as np

from marlspark.llm import quality_classifier as C
from marlspark.llm import quality_rules as R
from marlspark.llm.textstats import NAMES, counts


def brute(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    spans = {}
    for i in range(len(words) - 7):
        spans.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for v in spans.values() if len(v) > 1 for i in v for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts(docs):
    texts = [r.text for r in docs.collect()] + [None, "", "a b c d e f g h " * 3, "a b\n\na b\na b \n", "\x0b\x0c x\x1cy\xa0z"]
    for t in texts:
        assert counts(t)[:5] == brute(t)


def test_base_limits(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = R.query(d).join(labels, "doc_id").collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def _mcd(x, share=R.SHARE):
    """Of all rows at once: (mean, covariance) by concentration from both starts."""
    n, best = len(x), None
    at = lambda v, p: np.sort(v, axis=0)[max(0, math.ceil(p * n) - 1)]
    floor = np.array([f for _, f in R.VECTOR.values()])
    z = np.abs(x - at(x, 0.5)) / np.maximum((at(x, 0.75) - at(x, 0.25)) / 1.349, floor)
    for keep in (z.max(axis=1) <= 2.5, np.ones(n, bool)):
        if not keep.any():
            continue
        det, fit, part = math.inf, None, 1.0
        while True:
            y = x[keep]
            m = y.mean(axis=0)
            c, v, new = R.inverse((y.T @ y) / len(y) - np.outer(m, m), part)
            if part < 1 and new >= det - R.STILL:
                break
            det, fit = (new if part < 1 else math.inf), (m, c, v)
            d = np.einsum("ni,ij,nj->n", x - m, v, x - m)
            keep, part = d <= at(d, share), share
        if best is None or det < best[0]:
            best = (det, *fit[:2])
    return best[1:]


def _brute_distances(rows, prior=R.PRIOR):
    """(lang, source, vector) of every row to its distance."""
    x = np.array([r[2] for r in rows])
    groups = {}
    for i, (lang, source, _) in enumerate(rows):
        for g in ((lang, source), (lang,), ()):
            groups.setdefault(g, []).append(i)
    fits = {g: (len(at), *_mcd(x[at])) for g, at in groups.items()}
    out = np.zeros(len(rows))
    for g, at in groups.items():
        if len(g) == 2:
            m, c = R.shrunk(*fits[g], *R.shrunk(*fits[g[:1]], *fits[()][1:], prior), prior)
            y = x[at] - m
            out[at] = np.einsum("ni,ij,nj->n", y, np.linalg.inv(c), y)
    return out


def test_verdicts_equal_brute_force_and_reject_what_is_broken(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = R.vectors(R.statistics(d, "lang", "source")).collect()
    want = _brute_distances([(r.lang, r.source, [r[f"x{i}"] for i in range(R.P)]) for r in stats])
    got = {r.doc_id: r for r in R.query(d).collect()}
    limit = R.chi2_tail(R.TAIL, R.P)
    for r, w in zip(stats, want, strict=True):
        g = got[r.doc_id]
        assert abs(g.distance - w) <= 1e-6 * max(1.0, w), (r.doc_id, g.distance, w)
        assert g.kept == (not g.base_failed and g.distance <= limit)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    bad = [g for i, g in got.items() if quality.get(i) == 0 and not g.base_failed]
    good = [g for i, g in got.items() if quality.get(i) == 1 and not g.base_failed]
    assert bad and sum(not g.kept for g in bad) >= 0.8 * len(bad)
    assert sum(g.kept for g in good) >= 0.99 * len(good)


def test_few_rows_and_single_groups(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = R.query(d.limit(3)).collect()
    assert len(few) == 3 and all(r.distance is not None for r in few)
    m, c = R.shrunk(0, np.ones(R.P), np.eye(R.P), np.zeros(R.P), 2 * np.eye(R.P), 40.0)
    assert (m == 0).all() and (c == 2 * np.eye(R.P)).all()


def test_salted_join_gives_what_a_broadcast_gives(spark, docs, monkeypatch):
    want = {r.doc_id: round(r.distance, 6) for r in R.query(docs).collect()}
    monkeypatch.setattr(R, "FEW", 0)
    assert {r.doc_id: round(r.distance, 6) for r in R.query(docs).collect()} == want


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (2000, R.P))
    x[:400] += 5
    df = spark.createDataFrame([("g", i % R.SALTS, *map(float, v)) for i, v in enumerate(x)], "grp string, salt int, " + ", ".join(f"x{i} double" for i in range(R.P)))
    fit = R.estimates(df).first().fit
    assert all(abs(m) < 0.05 for m in fit.m)
    floor = np.array([f**2 for _, f in R.VECTOR.values()])
    assert np.all(np.abs(np.diag(R._square(fit.c)) - floor - 0.04) < 0.02)
    assert abs(R.chi2_cdf(R.chi2_tail(0.25, 6), 6) - 0.75) < 1e-9


def test_classifier_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = C.query(d, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_compiled_rules_equal_the_model(spark, docs):
    from marlspark.llm.textstats import statistics

    feats = C.features(statistics(docs))
    rows = feats.collect()
    x = np.array([[r[n] for n in C.FEATURES] for r in rows])
    y = (x[:, 4] < 0.1).astype(float)
    model = C.fit(x, y)
    assert model.rules and len(model.rules) < 120
    got = {r.doc_id: r.s for r in feats.select("doc_id", model.column().alias("s")).collect()}
    want = model.scores(x)
    assert all(abs(got[r.doc_id] - w) < 1e-9 for r, w in zip(rows, want, strict=True))


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (500, 30)).astype(float)
    y = z[:, 3]
    _, w = C.lasso(z, y, 0.02)
    assert np.argmax(np.abs(w)) == 3 and (np.abs(w) > 1e-4).sum() < 8


def test_lasso_is_at_its_optimum():
    """At the minimum the loss's slope is the penalty's: equal and opposite at weights, smaller where there's none."""
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, (400, 25)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + z[:, 2])))).astype(float)
    for penalty in (0.03, 0.01, 0.003):
        b, w = C.lasso(z, y, penalty, 4000)
        r = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = z.T @ r / len(y)
        assert abs(r.mean()) < 1e-4
        assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-4) and np.all(np.abs(slope + penalty * np.sign(w))[w != 0] < 1e-4)


def test_trees_split_where_all_splits_are_tried():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    g, h = (x[:, 2] > 0.3) - 0.4 + rng.normal(0, 0.1, 300), rng.random(300) + 0.1
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(4)]
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], 1)
    paths, value = C.grow(x, g, h, bins, codes, np.arange(4), 2, 10)
    tried = []
    for f in range(4):
        for t in bins[f]:
            low = x[:, f] <= t
            if 10 <= low.sum() <= 290:
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                tried.append((part(low) + part(~low), f, t))
    _, f, t = max(tried)
    assert paths[0].tests == ((f, False, float(t)),) and any(p.tests[0] == (f, True, float(t)) for p in paths)
    # leaves are the paths that no other goes on from; their rows have the leaf's own value
    tests = [p.tests for p in paths]
    for p in paths:
        if not any(len(q) > len(p.tests) and q[: len(p.tests)] == p.tests for q in tests):
            rows = p.holds(x)
            assert np.allclose(value[rows], g[rows].sum() / (h[rows].sum() + 1))


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert len(C.query(odd, labels).collect()) == odd.count()
    assert C.query(empty, labels).count() == 0
    assert {r.score for r in C.query(odd, labels.limit(0)).collect()} == {0.5}
    rows = R.query(odd).collect()
    assert len(rows) == odd.count() and all(r[n] is not None for r in rows for n in (*NAMES[:1], "base_failed", "kept"))
    assert R.query(empty).count() == 0


def test_many_rules_make_no_deep_expression(spark):
    """A sum of nested terms is a tree as deep as there are rules, whose planning takes the driver hundreds of megabytes or its stack."""
    rng = np.random.default_rng(1)
    rules = [C.Rule(tuple((int(rng.integers(12)), bool(rng.integers(2)), float(rng.random())) for _ in range(1 + i % 3))) for i in range(300)]
    model = C.Model(-0.3, rules, rng.normal(size=len(rules)).tolist())
    x = rng.random((50, 12))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], ["doc_id", *C.FEATURES])
    out = df.select("doc_id", model.column().alias("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, re.findall(r"\(+", plan))) < 50
    assert np.allclose([r.s for r in out.orderBy("doc_id").collect()], model.scores(x), rtol=0, atol=1e-12)
