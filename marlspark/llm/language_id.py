"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes, each is max-pooled over a
fixed-length window, and a softmax layer maps the pooled maxima to languages.
The network is trained in numpy on labelled text and applied to every window
of every text in batches; a text's distribution is the mean over its windows,
weighted by their bytes.

Defined results: a null text, or one with no letter, is `und` with score 0.
Rows with a null lang or doc_id don't train. With nothing to train on, every
text is `und` with score 0. Ties go to the alphabetically first language.
Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, pick, remainder

WINDOW = 256
PAD = 256
#: At once in a matrix product: small enough for the cache of a core.
BLOCK = 48

#: What may be a letter: of these, those of category L are.
_word = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    """A character of Unicode's category L; numbers like ² or Ⅷ are none."""
    return bool(text) and any(c.isalpha() for m in _word.finditer(text) for c in m[0])


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts one after another, padded at each text's end, and each text's number of windows (1 at least)."""
    counts = np.array([max(1, -(-len(b) // WINDOW)) for b in texts], dtype=np.int64)
    flat = np.full(int(counts.sum()) * WINDOW, PAD, dtype=np.int16)
    at = 0
    for b, n in zip(texts, counts, strict=True):
        flat[at : at + len(b)] = np.frombuffer(b, dtype=np.uint8)
        at += int(n) * WINDOW
    return flat.reshape(-1, WINDOW), counts


class ByteConvNet:
    """widths: bytes under a filter; filters: how many of each width; dim: of a byte's embedding."""

    def __init__(self, classes: list[str], widths=(2, 3, 4), filters: int = 8, dim: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.dim, self.span = classes, dim, max(widths)
        self.n = filters * len(widths)
        self.embed = rng.normal(0, 0.5, (PAD + 1, dim)).astype(np.float32)
        self.embed[PAD] = 0
        # filters of every width stand in one matrix; narrower ones have zeros beyond their width
        self.mask = np.repeat(np.stack([np.arange(self.span * dim) < w * dim for w in widths], 1), filters, axis=1).astype(np.float32)
        self.filters = (rng.normal(0, 1, (self.span * dim, self.n)) / np.sqrt(self.span * dim)).astype(np.float32) * self.mask
        self.shift = np.zeros(self.n, np.float32)
        self.dense = rng.normal(0, 0.1, (self.n, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, span * dim) of embedded bytes under the widest filter."""
        e = self.embed[x]
        w, length, d = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (w, length - self.span + 1, self.span * d), (s[0], s[1], s[2]))

    def _pooled(self, x: np.ndarray):
        cols = np.ascontiguousarray(self._columns(x))
        z = cols.reshape(-1, cols.shape[2]) @ self.filters
        return cols, z.reshape(cols.shape[0], cols.shape[1], self.n)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), BLOCK):
            _, z = self._pooled(x[i : i + BLOCK])
            h = np.maximum(z.max(axis=1) + self.shift, 0)
            s = h @ self.dense + self.bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            out[i : i + BLOCK] = s / s.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on the cross-entropy; the gradient goes through the position of each filter's maximum."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "shift", "dense", "bias")
        m1 = {k: np.zeros_like(getattr(self, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                xb, yb = x[at], y[at]
                cols, z = self._pooled(xb)
                top = z.argmax(axis=1)
                h = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + self.shift
                live = h > 0
                h = h * live
                s = h @ self.dense + self.bias
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.dense.T) * live
                under = cols[np.arange(len(at))[:, None], top]  # (batch, filters, span * dim)
                grads = {
                    "dense": h.T @ p,
                    "bias": p.sum(0),
                    "shift": dh.sum(0),
                    "filters": np.einsum("bfk,bf->kf", under, dh) * self.mask,
                }
                de = np.zeros_like(self.embed)
                pull = dh[:, :, None] * self.filters.T[None]  # (batch, filters, span * dim)
                for k in range(self.span):
                    byte = np.take_along_axis(xb, top + k, 1)
                    np.add.at(de, byte, pull[:, :, k * self.dim : (k + 1) * self.dim])
                de[PAD] = 0
                grads["embed"] = de
                step += 1
                for k in names:
                    m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                    to = getattr(self, k)
                    to -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, per_language: int = 1200, windows_per_text: int = 2) -> ByteConvNet | None:
    """Fit on a bounded sample: of each language about `per_language` texts, those with the smallest hashes of doc_id, windows of each at hashed places.

    A language's share of hashes follows from its number of rows, so that the
    sample needs no sort and no task gathers a language.
    """
    d = pick(docs, "doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each class of the network
    if not sizes:
        return None
    h = F.xxhash64("doc_id")
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, -(-per_language * (1 << 30) // n)))).otherwise(share)
    places = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)).cast("long")) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows_per_text)]
    few = d.filter(F.pmod(h, F.lit(1 << 30)) < share).filter("text RLIKE '\\\\p{L}'")
    few = few.select("lang", h.alias("h"), *[p.alias(f"w{k}") for k, p in enumerate(places)])
    # rows that repeat a doc_id could be many: one stands for all
    rows = [r["r"] for r in few.groupBy("h").agg(F.min(F.struct("lang", "h", *[f"w{k}" for k in range(windows_per_text)])).alias("r")).collect()]
    classes = sorted({r["lang"] for r in rows})
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["w0"])):
        for k in range(windows_per_text):
            if has_letter(r[f"w{k}"]):
                x.append(r[f"w{k}"].encode()[:WINDOW])
                y.append(classes.index(r["lang"]))
    return ByteConvNet(classes).fit(windows(x)[0], np.array(y)) if x else None


def identify(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred, score: every window of every text through the network."""

    def make():
        def run(texts):
            at = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if at:
                raw = [texts[i].encode() for i in at]
                w, counts = windows(raw)
                weight = (w != PAD).sum(axis=1).astype(np.float64)
                p = model.probabilities(w).astype(np.float64) * weight[:, None]
                first = np.r_[0, np.cumsum(counts)[:-1]]
                p = np.add.reduceat(p, first) / np.add.reduceat(weight, first)[:, None]
                best = p.argmax(axis=1)
                for i, k, row in zip(at, best, p, strict=True):
                    langs[i], scores[i] = model.classes[k], float(min(1.0, row[k]))
            return langs, scores

        return run

    return map_texts(documents(docs), "lang_pred string, score double", make)


def query(docs: DataFrame) -> DataFrame:
    """Train on the rows whose remainder isn't 0, predict all."""
    model = train(docs.filter(remainder(5) != 0))
    return identify(docs, model).withColumn("held_out", remainder(5) == 0).select("doc_id", "held_out", "lang_pred", "score")
