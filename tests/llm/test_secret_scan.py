import base64
import random
import re
import string

import numpy as np

from marlspark.llm import secret_scan as S


def brute(text):
    """Patterns as they are stated, one after another."""
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        out += [(m.start(), S.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    parts = ["token", "SECRET", "api_key", "ApiKey", " : ", "=", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", " ", "é", "\n", "pass", "word", "a.b-c_d+e/f"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert S.base_spans(t) == brute(t), t
        assert [x for x in S.scan(t) if x[1] < 3] == brute(t)


def test_recall_by_encoding_and_length():
    rng = random.Random(3)
    some = lambda letters: lambda n: "".join(rng.choice(letters) for _ in range(n * 4 // 3))
    make = {
        "base64": (lambda n: base64.b64encode(rng.randbytes(n)).decode(), {24: 0.8, 32: 0.95, 64: 0.97}), "base64url": (lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode(), {24: 0.8, 32: 0.95}),
        "base62": (some(string.ascii_letters + string.digits), {24: 0.75, 48: 0.95}), "letters": (some(string.ascii_letters), {48: 0.95}), "base36": (some(string.ascii_lowercase + string.digits), {100: 0.9}),
        "base32": (lambda n: base64.b32encode(rng.randbytes(n)).decode(), {100: 0.9}), "mixed": (some(string.ascii_letters + string.digits + "+/-_"), {48: 0.9}),
    }
    for name, (f, least) in make.items():
        for n, share in least.items():
            hit = sum(any(k == 3 for _, k, _ in S.scan(f"see {f(n)} there")) for _ in range(200))
            assert hit >= share * 200, (name, n, hit)


def test_names_are_not_found():
    for t in (
        "my_variable_name_2_with_number", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "internationalization-i18n-support", "chapter12section34paragraph56", "2024-01-01T00-00-00-report-final", "getUserById2FromCache3Now",
        "/usr/local/lib/python3/site-packages/numpy", "AbstractSingletonProxyFactoryBean", "com/example/MyClass2/doTheThing_v3", "DonaudampfschiffahrtsElektrizitaetenHauptbetriebswerk",
    ):
        assert S.scan(t) == []


def test_tails_against_simulation():
    rng = np.random.default_rng(5)
    for d, off in ((15, 10.0), (63, 50.0), (25, 3.0)):
        x = rng.noncentral_chisquare(d, off, 40000)
        for q in (0.05, 0.3, 0.8):
            assert abs(S.below(float(np.quantile(x, q)), d, off) - q) < 0.02
    t = rng.binomial(31, 0.3, 40000)
    assert all(abs(S.at_least(k, 31, 0.3) - (t >= k).mean()) < 0.02 for k in (0, 5, 9, 14, 31))
    shares = S._SHARES["base64"]
    p = np.array([S.runs(rng.choice(4, 200, p=shares), shares) for _ in range(3000)])
    assert abs((p < 0.1).mean() - 0.1) < 0.03


def test_tests_reject_patterns():
    rng = np.random.default_rng(2)
    p = [min(S.uniformity(x, 16), S.serial(x)) for x in (rng.integers(0, 16, 200) for _ in range(200))]
    assert 0.001 < np.mean(np.array(p) < 0.01) + 0.01 < 0.15
    assert S.uniformity(np.zeros(50, int), 16) < 1e-6 and S.serial(np.arange(50)) < 1e-6 and S.runs(np.array([0, 1] * 40), [0.5, 0.5, 0, 0]) < 1e-6


def test_odd_rows(odd, empty):
    rows = S.query(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    assert S.query(empty).count() == 0
    red = S.redacted(odd).collect()
    assert len(red) == len(rows) and S.redacted(odd).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token = 'abcdefghijkl' b", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert S.redacted(df).first().text == "a [ASSIGN]' b"
