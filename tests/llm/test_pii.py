import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from marlspark.llm import pii as P
from marlspark.llm.common import pick


def brute(text):
    """Patterns as they are stated, one after another."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [(P.KINDS.index(kind), m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


@pytest.fixture(scope="module")
def field():
    return P.fit(P.sentences())


def test_base_spans():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@", ".", "x-y", "com", " ", "+", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 1111", "-", "(", ")", "é", "\n", "3782", "%", "+1 (555) 010-2030", "10.0.0.1", "٣"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert sorted(P.base_spans(t)) == sorted(brute(t)), t


def test_long_runs_are_linear():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "a@" * 500_000, "+1" + " 1" * 500_000, "x" * 500_000 + "@" + "y" * 500_000):
        assert len(P.base_spans(t)) < 400_000


def test_best_path_and_gradient():
    rng = np.random.default_rng(1)
    step = rng.normal(size=(3, 3))
    chains = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 5)]
    for e, y in zip(chains, P.viterbi(chains, step), strict=True):
        score = lambda p: sum(e[t, k] + step[p[t - 1] if t else 0, k] for t, k in enumerate(p))  # noqa: B023, E731
        assert tuple(y) == max(itertools.product(range(3), repeat=len(e)), key=score)
    x = rng.integers(0, 5, (3, 4, 2)).astype(np.int32)
    mask = np.arange(4)[None] < np.array([4, 2, 1])[:, None]
    y = rng.integers(0, 3, (3, 4)).astype(np.int8)
    w = rng.normal(size=(6, 3))
    total, gw, gs = P.likelihood(x, y, mask, w, step)
    z = 0.0  # log-likelihood by all paths
    for i, n in enumerate((4, 2, 1)):
        e = w[x[i]].sum(1)
        score = lambda p: sum(e[t, k] + step[p[t - 1] if t else 0, k] for t, k in enumerate(p))  # noqa: B023, E731
        z += score(y[i, :n]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=n)))
    assert abs(total - z) < 1e-9
    for a, g in ((w, gw), (step, gs)):
        for at in ((0, 0), (2, 1), (1, 2)):
            a[at] += 1e-6
            up = P.likelihood(x, y, mask, w, step)[0]
            a[at] -= 1e-6
            assert abs((up - total) / 1e-6 - g[at]) < 1e-3


def test_held_out_sentences():
    rows = P.sentences(seed=3)
    random.Random(1).shuffle(rows)
    k = len(rows) * 3 // 4
    field = P.fit(rows[:k])
    good = bad = missed = 0
    for text, marked in rows[k:]:
        s = P.tokens(text)
        y = field.decode([field.ids(P.features(text, s))])[0]
        want = P.gold(s, marked)
        good, bad, missed = good + int(((y > 0) & (y == want)).sum()), bad + int(((y > 0) & (y != want)).sum()), missed + int(((want > 0) & (y != want)).sum())
    assert good > 300 and bad <= 0.03 * good and missed <= 0.03 * good, (good, bad, missed)


def test_variants_in_prose(field, docs):
    prose = [r.text for r in docs.filter("length(text) > 500").limit(40).collect()]
    rng, hit, n = random.Random(9), 0, 0
    for i in range(200):
        kind = P.KINDS[i % 4]
        value = P._value(kind, rng)
        text = prose[i % len(prose)]
        at = text.find(" ", 200)
        planted = f"{text[:at]} {value} {text[at + 1 :]}"
        spans = P.scan([planted], field)[0][1]
        n += 1
        hit += any(a < at + 1 + len(value) and z > at + 1 for _, a, z in spans)
    assert hit >= 0.9 * n, hit


def test_prose_is_left_alone(field, docs):
    texts = ["The report of 2024-01-15 has 312 pages, see section 3.4.1.", "At 10:45:30 on 15.01.2024 it cost $1,234.56", "ISBN 978-3-16-148410-0", "meet me at the dot com fair", ""]
    texts += [re.sub("[0-9@]", "", r.text or "") for r in docs.collect()]
    assert all(x == ([], []) for x in P.scan(texts, field))


def test_windows_do_not_change_what_is_found(field):
    rng = random.Random(2)
    gap = "lorem ipsum dolor sit amet consetetur " * 8
    for _ in range(20):
        parts = [P._value(rng.choice(P.KINDS), rng) for _ in range(3)]
        alone = [[(k, z - a) for k, a, z in P.scan([f"{gap}{p} {gap}"], field)[0][1]] for p in parts]
        together = P.scan([gap + f" {gap}".join(parts) + " " + gap], field)[0][1]
        assert sorted((k, z - a) for k, a, z in together) == sorted(x for p in alone for x in p)


def test_query_and_odd_rows(spark, docs, odd, empty):
    table = P.labelled(spark)
    got = P.query(docs, table)
    assert got.dtypes == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in P.KINDS], ("base_sha256", "string"), ("spans", "string")]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == len(text)
    for r in rows:
        b = sorted(brute(text[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in b) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(P.joined(b).encode()).hexdigest() and set(P.joined(b).split(",")) - {""} <= set(r.spans.split(","))
    assert [len(r.spans) for r in P.find(docs, P.train(table)).orderBy("doc_id").collect()] == [len(r.spans.split(",")) if r.spans else 0 for r in sorted(rows, key=lambda r: r.doc_id)]
    assert P.query(odd, table).count() == pick(odd, "doc_id").count() and P.query(empty, table).count() == 0
    nothing = spark.createDataFrame([], table.schema)
    assert [r.base_sha256 for r in P.query(docs, nothing).orderBy("doc_id").collect()] == [r.base_sha256 for r in sorted(rows, key=lambda r: r.doc_id)]
