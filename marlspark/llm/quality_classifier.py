"""Quality classifier: a sparse ensemble of rules.

Small trees are boosted on text statistics of a bounded sample of labelled
rows; every path from a root is a conjunctive rule; a lasso-penalised logistic
regression over the rules leaves few weights; and the rules that remain are
compiled into one Spark column expression, by which all rows are scored.

Defined results: a null text counts as empty. Several labels of a doc_id count
as their mean, rounded up. With no labelled row to learn from the score is
0.5; with one class, its smoothed share. Labels of null doc_ids or null
quality don't count. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, remainder
from .textstats import statistics

#: Labelled documents to fit on, about: those with the smallest hashes of doc_id.
SAMPLE = 8000
THRESHOLD = 0.3

FEATURES = {
    "log_words": "ln(n_words + 1)",
    "word_length": "word_chars / (n_words + 1)",
    "symbols": "n_symbols / (word_chars + 1)",
    "symbols_word": "n_symbols / (n_words + 1)",
    "pipes": "n_pipes / (n_words + 1)",
    "bangs": "n_bangs / (n_words + 1)",
    "upper": "n_upper / (n_upper + n_lower + 1)",
    "digits": "n_digits / (word_chars + 1)",
    "repeats": "n_repeat_words / (n_words + 1)",
    "adjacent": "n_adjacent / (n_words + 1)",
    "distinct": "n_distinct / (n_words + 1)",
    "dup_lines": "n_dup_lines / (n_lines + 1)",
}
_names = list(FEATURES)


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold): above means greater than, else at most."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= (x[:, f] > t) == above
        return out

    def sql(self) -> str:
        return " AND ".join(f"{_names[f]} {'>' if above else '<='} {float(t)!r}D" for f, above, t in self.tests) or "true"


@dataclass
class Model:
    bias: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """The score from columns named as FEATURES: a flat list of cases, added in order, so that the driver's planner meets no deep tree."""
        cases = ", ".join(f"CASE WHEN {r.sql()} THEN {float(w)!r}D ELSE 0D END" for r, w in zip(self.rules, self.weights, strict=True))
        total = f"aggregate(array({cases}), {float(self.bias)!r}D, (s, x) -> s + x)" if cases else f"{float(self.bias)!r}D"
        return F.expr(f"1D / (1D + exp(-({total})))")

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            total += w * r.holds(x)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, features: np.ndarray, depth: int, least: int):
    """One regression tree on gradients g and curvatures h: the tests of every path below the root, and each row's leaf value."""
    paths: list[Rule] = []
    value = np.zeros(len(x))

    def split(rows: np.ndarray, tests: tuple, level: int) -> None:
        if tests:
            paths.append(Rule(tests))
        best = (1e-9, -1, 0)
        gs, hs = g[rows].sum(), h[rows].sum() + 1
        if level < depth and len(rows) >= 2 * least:
            for f in features:
                k = len(bins[f])
                if not k:
                    continue
                c = codes[rows, f]
                n = np.cumsum(np.bincount(c, minlength=k + 1))[:-1]
                gl = np.cumsum(np.bincount(c, g[rows], k + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], k + 1))[:-1] + 1
                gain = gl**2 / hl + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / hs
                gain[(n < least) | (len(rows) - n < least)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(f), i)
        if best[1] < 0:
            value[rows] = gs / hs
            return
        _, f, i = best
        low = codes[rows, f] <= i
        t = float(bins[f][i])
        split(rows[low], (*tests, (f, False, t)), level + 1)
        split(rows[~low], (*tests, (f, True, t)), level + 1)

    split(np.arange(len(x)), (), 0)
    return paths, value


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients."""
    n = len(y)
    # the largest singular value by powers, a little more to be safe
    u = np.ones(z.shape[1] + 1)
    for _ in range(60):
        r = z @ u[1:] + u[0]
        u = np.r_[r.sum(), z.T @ r]
        size = float(np.linalg.norm(u))
        u /= max(size, 1e-300)
    step = 4.0 * n / max(1.05 * size, 1e-9)
    w, b = np.zeros(z.shape[1]), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> Model:
    if not len(y):
        return Model(0.0, [], [])
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if ones in (0.0, float(len(y))):
        return Model(base, [], [])
    rng = np.random.default_rng(seed)
    bins = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
        bins.append(q[q < x[:, f].max()])
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], 1)
    total, found = np.full(len(y), base), {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        paths, value = grow(x, y - p, p * (1 - p), bins, codes, rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)], depth, least)
        total += 0.3 * value
        for r in paths:
            found.setdefault(np.packbits(r.holds(x)).tobytes(), r)
    rules = list(found.values())
    if not rules:
        return Model(base, [], [])
    z = np.stack([r.holds(x) for r in rules], 1).astype(float)
    hold = rng.random(len(y)) < 0.25
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
        penalty = 1e-3
    else:
        losses = []
        for penalty in (1e-2, 3e-3, 1e-3, 3e-4):
            b, w = lasso(z[~hold], y[~hold], penalty, 200)
            p = np.clip(1 / (1 + np.exp(-(z[hold] @ w + b))), 1e-6, 1 - 1e-6)
            losses.append((-(y[hold] * np.log(p) + (1 - y[hold]) * np.log(1 - p)).mean(), penalty))
        penalty = min(losses)[1]
    b, w = lasso(z, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(b, [rules[i] for i in keep], [float(w[i]) for i in keep])


def features(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select("doc_id", *keep, *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def marks(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label of about `sample` labelled documents to learn from, those with the smallest hashes: few rows, whatever there are.

    The share of hashes follows from the number of labels, so that nothing is sorted.
    """
    some = pick(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder(5) != 0)
    n = some.count()
    share = min(1 << 30, -(-sample * (1 << 30) // max(1, n)))
    few = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    return few.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def train(feats: DataFrame, few: DataFrame) -> Model:
    """Fit on rows of feats that are in few, which marks() gives. Of rows that repeat a doc_id, which could be many, one counts."""
    one = feats.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *_names)).alias("r"))
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    return fit(np.array([[r["r"][n] for n in _names] for r in rows], float).reshape(-1, len(_names)), np.array([r["r"]["label"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows whose remainder is 0 aren't learned from."""
    feats = materialize(features(statistics(docs)), "features")
    model = train(feats, marks(labels, sample))
    out = feats.select("doc_id", (remainder(5) == 0).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose own text score() predicts 1 for, whatever their doc_ids."""
    few = materialize(marks(labels, sample), "marks")
    # only rows to learn from reach the statistics
    model = train(features(statistics(docs.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi"))), few)
    names = [c for c in docs.columns if c not in ("doc_id", "text")] + ["whole"]
    rows = features(statistics(docs.withColumn("whole", F.col("text")), *names), *names)
    return rows.filter(model.column() >= threshold).withColumnRenamed("whole", "text").select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
