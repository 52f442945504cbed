"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The base kinds are patterns with their rules (parts of an address, digits, the
Luhn sum). The field is trained from a small labelled table (text, spans); its
tokens are words, runs of digits and single marks, its features their shapes,
those of their neighbours, what is glued together, and cue words before. It is
decoded by Viterbi in numpy, many windows at a time.

Decoding is constrained: a token may be part of personal data only within REACH
characters of an anchor (a digit, an `@`, or a spelt-out "dot"); all others are
outside. A path's score then falls apart into windows around anchors with
outside tokens between them, so that decoding these windows is decoding the
whole text under that constraint, and prose without anchors costs next to
nothing. What the field finds is added where it passes its kind's rule (digits,
parts, the Luhn sum, an at and a dot) and overlaps no base span.

Positions are code points, ends exclusive. Defined results: a null text counts
as empty and has no spans. Repeated rows get equal results; other columns are
ignored. An empty labelled table adds nothing. Training reads at most MOST rows
of the labelled table, those with the smallest hashes of their text.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts

KINDS = ("email", "ip", "card", "phone")
MOST, REACH = 2000, 40
NEVER = -1e4

# The base patterns. IP has a look-behind for speed alone: a match can't begin within digits that one from their start has failed on.
MARKS = "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
DOT = re.compile(r"(?<![^\W_])dot(?![^\W_])", re.I)
#: An address in words: something, an at, labels with dots between, the last of two letters or more.
SPELT = re.compile(r"[\w.%+-]+\s*(?:@|[(\[{<]\s*at\s*[)\]}>]|\sat\s)\s*(?!dot\b)[\w-]+(?:\s*(?:\.|[(\[{<]\s*dot\s*[)\]}>]|\sdot\s)\s*(?!dot\b)[\w-]+)*\s*(?:\.|[(\[{<]\s*dot\s*[)\]}>]|\sdot\s)\s*(?!dot\b)[^\W\d_]{2,}", re.I)
#: Words that tell of a kind.
CUES = {
    "email": ("mail", "email", "e", "contact", "contacto", "kontakt", "courriel", "correo", "write"), "ip": ("ip", "host", "server", "address", "client", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "cell", "ring", "llame", "appelez", "fon"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_B = {k: 1 + 2 * i for i, k in enumerate(KINDS)}


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the weighted sum of digits is divisible by ten."""
    d = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(int) - 48
    twice = d[1::2] * 2
    return int(d[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from the marks on: what stands before a mark is read back to the last match's end."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and (text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in MARKS)):
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no address holds two marks
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out = [(0, a, z) for a, z in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- the field ---


def shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        n = len(token)
        small = n <= 3 and int(token) <= 255
        return f"d{n if n <= 6 else '7-9' if n <= 9 else '10-12' if n <= 12 else '13-15' if n <= 15 else n if n <= 19 else 'long'}{'s' if small else ''}"
    if not token[0].isalpha():
        return token
    low = token.lower()
    if low in _CUE or low in ("at", "dot"):
        return low
    case = "x" if token.islower() else "X" if token.isupper() else "Xx"
    return case + ("2" if len(token) <= 2 else "4" if len(token) <= 4 else "8" if len(token) <= 8 else "+")


def tokens(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi)]


def features(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    """The same number of features for each token."""
    s = ["^", "^", *(shape(text[a:z]) for a, z in spans), "$", "$"]
    n = len(spans)
    glue = [i > 0 and spans[i - 1][1] == spans[i][0] for i in range(n)] + [False]
    # digits of the run of glued tokens that a token stands in
    run, first = [0] * n, 0
    for i in range(1, n + 1):
        if i == n or not glue[i]:
            d = sum(z - a for j, (a, z) in enumerate(spans[first:i]) if s[first + j + 2][0] == "d" and s[first + j + 2] != "dot")
            run[first:i] = [min(d, 20)] * (i - first)
            first = i
    out, cue, since = [], "", 99
    for i in range(n):
        p2, p, c, f, f2 = s[i : i + 5]
        g, h = "" if glue[i] else " ", "" if glue[i + 1] else " "
        told = cue if since <= 4 else ""
        out.append(("b", f"0{c}", f"1{p}{g}", f"2{h}{f}", f"3{p2}_{p}", f"4{f}_{f2}", f"5{p}{g}{c}", f"6{c}{h}{f}", f"7{p}{g}{c}{h}{f}", f"8{told}", f"9{told}{c}", f"r{run[i]}", f"q{run[i]}{c}", f"t{p2}_{p}{g}{c}", f"u{c}{h}{f}_{f2}"))
        since += 1
        if c in _CUE:
            cue, since = _CUE[c], 1
    return out


def _legal() -> np.ndarray:
    """0 where a label may follow another, else NEVER: I goes on from B or I of its kind."""
    n = len(LABELS)
    t = np.zeros((n, n))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            t[:, j] = NEVER
            t[j - 1, j] = t[j, j] = 0
    return t


LEGAL = _legal()


@dataclass
class Field:
    """index: ids of features. weights: features (the last row is of unknown ones) by labels. step: between labels. The first label is taken as after O."""

    index: dict[str, int]
    weights: np.ndarray
    step: np.ndarray

    def ids(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        none = len(self.index)
        return np.array([[self.index.get(f, none) for f in r] for r in rows], np.int32).reshape(len(rows), -1)

    def decode(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each window's feature ids; windows of like lengths go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(windows)
        order = sorted((i for i in range(len(windows)) if len(windows[i])), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            longest = len(windows[order[at]])
            upto = at + 1
            while upto < len(order) and len(windows[order[upto]]) * (upto + 1 - at) <= max(40_000, longest):
                upto += 1
            part = order[at:upto]
            for i, y in zip(part, viterbi([self.weights[windows[i]].sum(1) for i in part], self.step), strict=True):
                out[i] = y
            at = upto
        return out


def viterbi(scores: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """Best paths of several chains, by token scores and steps between labels; shorter chains stop moving at their ends."""
    n, m, k = len(scores), max(map(len, scores)), step.shape[0]
    length = np.array([len(s) for s in scores])
    e = np.zeros((m, n, k))
    for i, s in enumerate(scores):
        e[: len(s), i] = s
    best, back = e[0] + step[0], np.zeros((m, n, k), np.int8)
    for t in range(1, m):
        through = best[:, :, None] + step[None]
        move = through.argmax(1)
        live = (t < length)[:, None]
        back[t] = np.where(live, move, np.arange(k))
        best = np.where(live, np.take_along_axis(through, move[:, None, :], 1)[:, 0] + e[t], best)
    y = np.zeros((m, n), np.int8)
    y[-1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(m - 1, 0, -1):
        y[t - 1] = back[t, rows, y[t]]
    return [y[: length[i], i] for i in range(n)]


def gold(spans: list[tuple[int, int]], marked: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels of tokens under marked spans (kind, start, end)."""
    y = np.zeros(len(spans), np.int8)
    for kind, lo, hi in marked:
        inside = [i for i, (a, z) in enumerate(spans) if a >= lo and z <= hi]
        for j, i in enumerate(inside):
            y[i] = _B[kind] + (j > 0)
    return y


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels y [n, m] of chains with feature ids x [n, m, f], and its gradients by weights and steps. mask: real tokens, from the left."""
    n, m, _ = x.shape
    k = step.shape[0]
    e = weights[x].sum(2)
    rows = np.arange(n)
    a = np.empty((m, n, k))
    a[0] = e[:, 0] + step[0]
    for t in range(1, m):
        new = _lse(a[t - 1][:, :, None] + step[None], 1) + e[:, t]
        a[t] = np.where(mask[:, t, None], new, a[t - 1])
    z = _lse(a[-1], 1)
    b = np.zeros((m, n, k))
    pairs = np.zeros((k, k))
    for t in range(m - 1, 0, -1):
        on = e[:, t] + b[t]
        live = mask[:, t]
        joint = np.exp(a[t - 1][:, :, None] + step[None] + on[:, None, :] - z[:, None, None])
        pairs += joint[live].sum(0)
        b[t - 1] = np.where(live[:, None], _lse(step[None] + on[:, None, :], 2), b[t])
    p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
    pairs[0] += p[:, 0].sum(0)
    of = np.zeros((n, m, k))
    of[rows[:, None], np.arange(m)[None], y] = 1
    of *= mask[:, :, None]
    before = np.concatenate([np.zeros((n, 1), y.dtype), y[:, :-1]], 1)
    seen = np.zeros((k, k))
    np.add.at(seen, (before[mask], y[mask]), 1)
    total = float((e * of).sum() + (step * seen).sum() - z.sum())
    d = of - p
    flat = x.reshape(-1)
    wide = np.repeat(d.reshape(-1, k), x.shape[2], 0)
    grad = np.stack([np.bincount(flat, wide[:, j], weights.shape[0]) for j in range(k)], 1)
    return total, grad, seen - pairs


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, ridge: float = 0.02) -> Field:
    """By Adam over all rows at once, with a ridge. rows: (text, marked spans)."""
    cut = [(t, tokens(t), m) for t, m in rows]
    cut = [c for c in cut if c[1]]
    feats = [features(t, s) for t, s, _ in cut]
    index: dict[str, int] = {}
    for f in feats:
        for r in f:
            for x in r:
                index.setdefault(x, len(index))
    weights, step = np.zeros((len(index) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    field = Field(index, weights, step + LEGAL)
    if not cut:
        return field
    n, m = len(cut), max(len(f) for f in feats)
    x, y, mask = np.full((n, m, len(feats[0][0])), len(index), np.int32), np.zeros((n, m), np.int8), np.zeros((n, m), bool)
    for i, (f, c) in enumerate(zip(feats, cut, strict=True)):
        x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = field.ids(f), gold(c[1], c[2]), True
    moments = [np.zeros_like(v) for v in (weights, weights, step, step)]
    for r in range(1, rounds + 1):
        _, gw, gs = likelihood(x, y, mask, weights, step + LEGAL)
        gw[-1] = 0  # what is unknown or padding has no weight
        for v, g, (i, j) in ((weights, gw - ridge * weights, (0, 1)), (step, gs - ridge * step, (2, 3))):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[j] = 0.99 * moments[j] + 0.01 * g * g
            v += 0.15 * (moments[i] / (1 - 0.9**r)) / (np.sqrt(moments[j] / (1 - 0.99**r)) + 1e-8)
    return Field(index, weights, step + LEGAL)


# --- the labelled table ---

#: Sentences of the labelled table; {k} is a place for a kind, and the rest of them have none.
SENTENCES = (
    "Please write to {email} for details.", "Contact: {email}", "My new address is {email}, thanks", "{email} or call {phone}", "kontakt {email} oder Telefon {phone}", "Envoyez un courriel à {email}.", "correo {email} y tel {phone}",
    "Call me at {phone} tomorrow.", "Tel: {phone}", "fax {phone}", "Ring {phone} after five", "Reach us under {phone}.", "llame al {phone} hoy", "appelez le {phone}", "phone {phone}, mobile {phone}", "She said {phone} and left",
    "The server {ip} is down", "ping {ip}", "host {ip} port 8080", "blocked client {ip}.", "from {ip} to {ip}", "adresse IP {ip} gesperrt", "servidor {ip} caído",
    "Card number {card} expires 12/27", "pay with visa {card}", "{card}", "mastercard: {card}", "Karte {card} wurde belastet", "tarjeta {card}", "la carte {card} est refusée",
    "lorem ipsum {ip} dolor sit amet", "and so on {email} and so forth", "quelque part {phone} ou ailleurs", "irgendwo {card} im Text", "Sed ut {email}, perspiciatis", "en el texto {ip} sin más", "these words {phone} those words", "here {card} there", "over {email} under", "word. {ip} Word again",
    "mail {email} please", "ask {email} today", "it went to {email} and {email} by mistake", "meet us at the dot com fair", "look at the dot on it", "a dot at the end of a line",
    "The report of 2024-01-15 has 312 pages.", "On 15.01.2024 at 10:45:30 it began", "Version 1.2.3 and 4.0.12 are out", "It costs $1,234.56 or 1.234,56 EUR", "Between 1999-2004 and 2010-2015", "Order #123456 of 20 items", "ISBN 978-3-16-148410-0 in print",
    "See section 3.4.1 and page 12", "at 52.5200, 13.4050 on the map", "1. first 2. second 3. third", "We met at the station at 9", "The dot com years at large", "1024x768 pixels, 24 bit", "p = 0.05, n = 1200", "about 1 000 000 people in 2020", "Mix 250 g at 180 degrees for 45 minutes",
    "chapter 12, verse 7-9", "id 20240115103000 was logged", "5 - 3 = 2 and 10 / 2 = 5", "look at me @ noon", "@handle and #tag", "room 101 at level 2", "ratio 16:9 or 4:3", "license 2.0 at a glance", "score 3-2 after 90 minutes", "dates 01/02/2023 - 03/04/2023", "lot 4711-0815-42 arrived",
)
_NAMES = ("jane", "tom", "maria", "li", "otto", "ana", "sam", "petra", "joe", "noor")
_HOSTS = ("example", "mail", "post", "corp", "uni", "shop", "labs", "web2")
_TOPS = ("com", "org", "net", "de", "fr", "io", "es")


def _value(kind: str, rng: random.Random) -> str:
    """A value of a kind in one of the forms that people write."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, host, top = rng.choice(_NAMES) + rng.choice(["", "." + rng.choice(_NAMES), d(2), "_" + rng.choice(_NAMES)]), rng.choice(_HOSTS), rng.choice(_TOPS)
        at = rng.choice(["@", "@", " @ ", " (at) ", " [at] ", "(at)", "[at]", " at "])
        return name + at + host + (rng.choice([" dot ", " dot "]) if at == " at " else rng.choice([".", ".", " . ", " dot ", " (dot) ", " [dot] ", "(dot)", "[dot]"])) + top
    if kind == "ip":
        return rng.choice([".", ".", " . ", "[.]", " [.] ", "(.)", " dot "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(["", " ", "-", ".", "/", "  "]).join(digits[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([
        f"+{d(2)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"00{d(2)} {d(3)} {d(6)}",
        f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)}{d(9)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}-{d(6)}", f"({d(4)}) {d(6)}", f"+{d(2)} {d(3)} {d(7)}",
    ])


def sentences(seed: int = 11, copies: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with places filled, each several times, and their spans."""
    rng, out = random.Random(seed), []
    for s in SENTENCES:
        for _ in range(copies if "{" in s else 3):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", s):
                if part.startswith("{"):
                    v = _value(part[1:-1], rng)
                    spans.append((part[1:-1], len(text), len(text) + len(v)))
                    part = v
                text += part
            if rng.random() < 0.3:  # numbers in prose are no one's data
                text = re.sub(r"(?<=\D )(\d\d)(?= \D)", lambda m: str(rng.randrange(1, 3000)), text) if not spans else text
            out.append((text, spans))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: text, spans."""
    return spark.createDataFrame(sentences(), "text string, spans array<struct<kind:string,start:int,end:int>>")


@lru_cache(maxsize=4)
def _fitted(rows: tuple) -> Field:
    return fit([(t, list(m)) for t, m in rows])


def train(table: DataFrame) -> Field:
    """The field of a labelled table; rows without a text count as empty."""
    rows = table.select(F.coalesce("text", F.lit("")).alias("text"), "spans").orderBy(F.xxhash64("text"), "text", F.to_json("spans")).limit(MOST).collect()
    return _fitted(tuple((r.text, tuple((s.kind, s.start, s.end) for s in r.spans or [] if s.kind in KINDS)) for r in rows))


# --- applying it ---


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH of an anchor, widened to white space (at most REACH further)."""
    if text.isascii():
        c = np.frombuffer(text.encode(), np.uint8)
    else:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
    if "dot" in text or "DOT" in text or "Dot" in text:
        at = np.sort(np.concatenate([at, np.array([m.start() for m in DOT.finditer(text)], np.int64)]))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 4 * REACH + 2)
    out = []
    for a, z in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist(), strict=True):
        lo, hi = max(0, a - REACH), min(len(text), z + 1 + REACH)
        least, most = max(0, lo - REACH), min(len(text), hi + REACH)
        while lo > least and not text[lo - 1].isspace():
            lo -= 1
        while hi < most and not text[hi].isspace():
            hi += 1
        out.append((lo, hi))
    return out


def _good(kind: str, text: str) -> bool:
    """The rule of a kind for what the field has found."""
    d = _digits(text)
    if kind == "phone":
        return 8 <= len(d) <= 15 and not re.search(r"[^\W\d_]", text)
    if kind == "card":
        return 13 <= len(d) <= 19 and len(text) <= 60 and luhn(d) and not re.search(r"[^\W\d_]", text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W\d_]", DOT.sub("", text))
    return len(text) <= 320 and bool(SPELT.fullmatch(text))


def scan(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the base spans, and all spans (kind, start, end) by kind, then start: those, and what the field adds."""
    texts = [t or "" for t in texts]
    base = [sorted(base_spans(t)) for t in texts]
    places, ids, cuts = [], [], []
    for i, t in enumerate(texts):
        for lo, hi in windows(t):
            s = tokens(t, lo, hi)
            if s:
                places.append(i)
                cuts.append(s)
                ids.append(field.ids(features(t, s)))
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, s, y in zip(places, cuts, field.decode(ids), strict=True):
        j = 0
        while j < len(y):
            if y[j] == 0:
                j += 1
                continue
            k, first = (int(y[j]) - 1) // 2, j
            j += 1
            while j < len(y) and y[j] == 2 * k + 2:
                j += 1
            more[i].append((k, s[first][0], s[j - 1][1]))
    out = []
    for t, b, extra in zip(texts, base, more, strict=True):
        taken = sorted((a, z) for _, a, z in b)
        starts = np.array([a for a, _ in taken])
        upto = np.maximum.accumulate(np.array([z for _, z in taken])) if taken else starts
        every = list(b)
        for k, a, z in extra:
            before = int(np.searchsorted(starts, z)) - 1
            if (before < 0 or upto[before] <= a) and _good(KINDS[k], t[a:z]):
                every.append((k, a, z))
        out.append((b, sorted(every)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{z}" for k, a, z in spans])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end)."""

    def make():
        return lambda texts: ([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in x] for _, x in scan(texts, field)],)

    return map_texts(documents(docs), "spans array<struct<kind:string,start:int,end:int>>", make)


def query(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans."""
    field = train(table)

    def make():
        def run(texts):
            found = scan(texts, field)
            counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(4)]
            return (*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(x) for _, x in found])

        return run

    return map_texts(documents(docs), "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", make)
