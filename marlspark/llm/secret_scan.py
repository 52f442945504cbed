"""Secret scans: fixed patterns, and a randomness test battery for the rest.

The base kinds are patterns. Beyond them every long run of code characters is
a candidate: an encoding is inferred from its characters, and a battery tests
its symbols: chi-squared uniformity over the encoding's alphabet, runs of
character classes (lower, upper, digit, other), and lag-one serial correlation.

The battery is read both ways. Fisher's combination of the three p-values under
randomness rejects what random data would hardly show. And the statistics of
uniformity and of runs are held against the null of written names, which vary
from uniform by a non-centrality that grows with length, and change class
seldom: their tails under that null, combined by Fisher's method, are the
p-value of a candidate. It falls with length, as a short string can't differ
clearly from a name; the Benjamini-Hochberg rule over a text's candidates then
controls the false discoveries, each weighed by its length.

Positions are code points, ends exclusive. Defined results: a null text counts
as empty and has no spans; ties in position go by kind as listed; a candidate
that overlaps a base span adds nothing. Repeated rows get equal results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, pick

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Fixed value: the chance that two letters of English text are the same.
SAME = 0.0655
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from the narrowest on; the first that holds all characters of a candidate is its encoding.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("hex_upper", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36_upper", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base66", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS}
#: Of the letters' own variation from uniform so much counts as ordinary at least, and so many neighbours of a name differ in class at most.
ORDINARY, CHANGES = 0.5, 0.3


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


_SHARES = {name: [sum(_class(c) == k for c in a) / len(a) for k in range(4)] for name, a in ENCODINGS}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def infer(token: str) -> str | None:
    have = set(token)
    return next((name for name, index in _INDEX.items() if have <= index.keys()), None)


def _normal(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(x: np.ndarray, k: int) -> float:
    """Of symbols against the uniform distribution over k."""
    return float((np.bincount(x, minlength=k).astype(float) ** 2).sum()) * k / len(x) - len(x)


def uniformity(x: np.ndarray, k: int) -> float:
    """Upper p-value of chi-squared over an alphabet of k symbols (Wilson and Hilferty's cube root)."""
    stat, d = chi_squared(x, k), k - 1
    z = ((stat / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) if stat > 0 else -8.0
    return 0.5 * math.erfc(z / math.sqrt(2))


def below(stat: float, d: int, off: float) -> float:
    """P(X <= stat) of a chi-squared X with d degrees of freedom and non-centrality off (Sankaran's power)."""
    if stat <= 0:
        return 0.0
    s = d + off
    h = 1 - 2 / 3 * s * (d + 3 * off) / (d + 2 * off) ** 2
    q = (d + 2 * off) / s**2
    m = (h - 1) * (1 - 3 * h)
    z = ((stat / s) ** h - (1 + h * q * (h - 1 - 0.5 * (2 - h) * m * q))) / (h * math.sqrt(2 * q) * (1 + 0.5 * m * q))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def changes(kinds: np.ndarray) -> int:
    """Neighbours of different classes: one fewer than runs."""
    return int((kinds[1:] != kinds[:-1]).sum())


def runs(kinds: np.ndarray, shares: list[float]) -> float:
    """Two-sided p-value of the number of runs of classes that have these shares of the alphabet."""
    n = len(kinds) - 1
    q = 1 - sum(p * p for p in shares)
    if n < 1 or q == 0:
        return 1.0
    near = sum(p * (1 - p) ** 2 for p in shares) - q * q
    var = n * q * (1 - q) + 2 * (n - 1) * near
    return _normal((changes(kinds) - n * q) / math.sqrt(var)) if var > 0 else 1.0


def at_least(t: int, n: int, q: float) -> float:
    """P(T >= t) of a binomial T."""
    if t <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log(1 - q) for i in range(t, n + 1)]
    return min(1.0, math.fsum(map(math.exp, log)))


def serial(x: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbours."""
    c = x - x.mean()
    v = float((c * c).sum())
    if v == 0:
        return 0.0
    n = len(x)
    return _normal((float((c[1:] * c[:-1]).sum()) / v + 1 / n) * math.sqrt(n))


def fisher(*ps: float) -> float:
    """Fisher's combination of independent p-values."""
    h = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 1.0
    for k in range(1, len(ps)):
        term *= h / k
        total += term
    return math.exp(-h) * total


def battery(token: str, encoding: str) -> tuple[float, float]:
    """Combined p-values of a candidate: under randomness (small: it isn't random), and under the null of a written name (small: it isn't a name)."""
    index, shares = _INDEX[encoding], _SHARES[encoding]
    k, n = len(index), len(token)
    x, kinds = np.array([index[c] for c in token]), np.array([_class(c) for c in token])
    random = fisher(uniformity(x, k), runs(kinds, shares), serial(x))
    tails = [below(chi_squared(x, k), k - 1, n * ORDINARY * max(0.0, k * SAME - 1))]
    if 1 - sum(p * p for p in shares) > CHANGES:  # in others names change class as often as random symbols
        tails.append(at_least(changes(kinds), n - 1, CHANGES))
    return random, fisher(*tails)


def random_spans(text: str, taken: list[tuple[int, int, int]], level: float = 1e-4, reject: float = 1e-3) -> list[tuple[int, int, int]]:
    """Spans of kind `random`. level: of false discoveries; reject: the battery's level for 'not random'."""
    found = []
    for m in CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < z for a, _, z in taken):
            continue
        token = m[0].rstrip("=")
        encoding = infer(token)
        if encoding:
            random, name = battery(token, encoding)
            found.append((name if random >= reject else 1.0, len(token), m.start(), m.end()))
    # weights that are 1 on average: of equal evidence the longer candidate's counts more
    mean = sum(f[1] for f in found) / len(found) if found else 1.0
    ranked = sorted((p * mean / n, a, z) for p, n, a, z in found)
    most = max((i for i, f in enumerate(ranked, 1) if f[0] <= level * i / len(ranked)), default=0)
    return [(a, 3, z) for _, a, z in ranked[:most]]


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end), in order."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + random_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{z}" for a, k, z in spans])


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the first one's kind."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, z = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < z:
            i += 1
            z = max(z, spans[i][2])
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = z
        i += 1
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end)."""

    def make():
        return lambda texts: ([[{"start": a, "kind": KINDS[k], "end": z} for a, k, z in scan(t)] for t in texts],)

    return map_texts(documents(docs), "spans array<struct<start:int,kind:string,end:int>>", make)


def redacted(docs: DataFrame) -> DataFrame:
    """The columns of documents with secrets replaced in text, and n_chars counted again where text changed."""

    def make():
        return lambda texts: ([redact(t, scan(t)) for t in texts],)

    keep = ("doc_id", "lang", "source", "n_chars", "text")
    d = pick(documents(docs, "lang", "source", "n_chars"), "doc_id", "lang", "source", "n_chars", "text")
    out = map_texts(d.withColumn("value", F.col("text")).select(*keep[:4], "value"), "text string", make, "value", keep[:4])
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")).alias("n_chars"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans."""

    def make():
        def run(texts):
            found = [scan(t) for t in texts]
            base = [[s for s in x if s[1] < 3] for x in found]
            counts = [[sum(s[1] == k for s in x) for x in base] for k in range(3)]
            return (*counts, [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in found])

        return run

    return map_texts(documents(docs), "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", make)
