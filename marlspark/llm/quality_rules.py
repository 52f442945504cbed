"""Quality rules: fixed limits, and robust multivariate outliers.

Each text's statistics are transformed to a vector. For every language and
source, every language, and all rows, the minimum covariance determinant gives
location and scatter: from two deterministic starts (the rows near the medians;
all rows), each concentration step keeps the `share` of the rows with the
smallest distance and takes their mean and covariance, until no determinant
falls any more; the start that ends with the smaller one counts. A language's
estimate is shrunk towards that of all rows, and a source's towards its
language's, by the weight of `prior` rows, so that a group of few rows is
judged by the next larger one and no size makes a difference in kind. A text is
rejected where its squared Mahalanobis distance is beyond the chi-squared
quantile `tail`.

Every step is an aggregation over all rows with a row of sums for each group
and task; a group's rows are never gathered. Groups' parameters are broadcast
while they are few, else joined over salts, so that neither their number nor a
group's size is bounded.

Defined results: a null text has no words and fails. Null lang or source are a
group of their own. Ties at the kept share all stay. Repeated rows each count.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, pick
from .textstats import statistics

SHARE = 0.75
TAIL = 1e-12
PRIOR = 40.0
#: A logarithm of a determinant that falls by less stands still.
STILL = 1e-4
SALTS = 64
#: Groups whose parameters are broadcast, at most: some 600 bytes each.
FEW = 20_000
TASKS = 8

LIMITS = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

#: name: (SQL over the statistics, least standard deviation, so that statistics that hardly vary don't reject all that do)
VECTOR = {
    "x0": ("ln((word_chars + 250) / (n_words + 50))", 0.04),
    "x1": ("sqrt(n_symbols / (word_chars + 50))", 0.03),
    "x2": ("n_upper / (n_upper + n_lower + 50)", 0.02),
    "x3": ("sqrt(n_adjacent / (n_words + 20))", 0.03),
    "x4": ("sqrt(n_repeat_words / (n_words + 20))", 0.1),
    "x5": ("sqrt(n_bangs / (word_chars + 50))", 0.03),
}
P = len(VECTOR)
_pairs = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_cdf(x: float, df: int) -> float:
    """For even degrees of freedom."""
    h, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= h / k
        total += term
    return 1 - math.exp(-h) * total


def chi2_tail(p: float, df: int) -> float:
    """The value beyond which the share p lies (even degrees of freedom)."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        h, term, total = x / 2, 1.0, 1.0
        for k in range(1, df // 2):
            term *= h / k
            total += term
        lo, hi = (x, hi) if math.exp(-h) * total > p else (lo, x)
    return hi


def _meet(rows: DataFrame, params: DataFrame, few: bool, *by: str) -> DataFrame:
    """Rows with their group's parameters. A group may hold a third of all rows: beyond a broadcast its rows are dealt over salts, and its parameters repeated for each."""
    by = by or ("grp",)
    if few:
        return rows.join(F.broadcast(params), list(by))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return rows.join(params.withColumn("salt", F.explode(salts)).hint("merge"), [*by, "salt"])


_FIT = "struct<det: double, m: array<double>, c: array<double>, v: array<double>>"
#: Squared distance under a fit: its mean m, and of its inverse v the lower triangle.
_DISTANCE = " + ".join(f"{1 if i == j else 2} * (x{i} - fit.m[{i}]) * (x{j} - fit.m[{j}]) * fit.v[{k}]" for k, (i, j) in enumerate(_pairs))


def _square(lower) -> np.ndarray:
    """The symmetric matrix with this lower triangle."""
    out = np.zeros((P, P))
    for (i, j), x in zip(_pairs, lower, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _lower(c: np.ndarray) -> list[float]:
    return [float(c[i, j]) for i, j in _pairs]


def inverse(c: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a covariance the consistent one, its inverse and log-determinant.

    A normal group's nearest `share` of rows vary less than all: the usual
    factor mends that. Floors stand on the diagonal, so that there is an inverse.
    """
    factor = share / chi2_cdf(chi2_tail(1 - share, P), P + 2) if share < 1 else 1.0
    c = factor * c + np.diag([f**2 for _, f in VECTOR.values()])
    return c, np.linalg.inv(c), float(np.linalg.slogdet(c)[1])


def shrunk(n: float, mean: np.ndarray, c: np.ndarray, whole_mean: np.ndarray, whole_c: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows, joined by `prior` rows of a larger group."""
    w = n / (n + prior)
    off = mean - whole_mean
    return w * mean + (1 - w) * whole_mean, w * c + (1 - w) * whole_c + w * (1 - w) * np.outer(off, off)


def _solve(sums: DataFrame, share: float) -> DataFrame:
    """The fit of each start's sums. Determinants of the start itself are infinite, so that the first step counts."""

    def run(frames):
        for f in frames:
            fits = []
            for n, x in zip(f["n"], f["x"], strict=True):
                x = np.asarray(x, float) / n
                m = x[:P]
                c, v, det = inverse(_square(x[P:]) - np.outer(m, m), share)
                fits.append({"det": det if share < 1 else math.inf, "m": m.tolist(), "c": _lower(c), "v": _lower(v)})
            yield pd.DataFrame({"grp": f["grp"], "start": f["start"], "total": f["total"], "fit": pd.Series(fits, dtype=object)})

    return sums.mapInPandas(run, f"grp string, start string, total bigint, fit {_FIT}")


def _sums(rows: DataFrame) -> DataFrame:
    """For each group and start the number of rows, and sums and products in one array."""
    sums = [f"sum({x})" for x in [f"x{i}" for i in range(P)] + [f"x{i} * x{j}" for i, j in _pairs]]
    return rows.groupBy("grp", "start").agg(*map(F.expr, ("max(total) AS total", "count(1) AS n", f"array({', '.join(sums)}) AS x")))


def vectors(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """stats with its transformed vector, a salt by place in the table, and its groups: grp (language and source), tongue (language)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    # the first part's length tells where the second begins
    grp = F.concat(F.lit("S"), F.length(part(lang)).cast("string"), part(lang), F.lit("/"), part(source))
    out = stats.withColumn("grp", grp).withColumn("tongue", F.concat(F.lit("L"), part(lang)))
    return out.withColumns({k: F.expr(c) for k, (c, _) in VECTOR.items()}).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))


def _narrow(df: DataFrame, few: bool) -> DataFrame:
    """The rows of few groups need no more tasks than this."""
    return df.coalesce(TASKS) if few else df


def estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """grp, total, and a fit for every group of stored rows with grp, x* and salt."""
    spark, x = rows.sparkSession, [f"x{i}" for i in range(P)]
    rows = rows.select("grp", "salt", *x)
    quart = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), *[F.expr(f"percentile_approx({c}, array(0.25, 0.5, 0.75), 1000) AS p{c}") for c in x])
    quart = materialize(quart, "quartiles")
    few = quart.count() <= FEW
    near = ", ".join(f"abs({c} - p{c}[1]) / greatest((p{c}[2] - p{c}[0]) / 1.349D, {f}D)" for c, (_, f) in VECTOR.items())
    begun = _meet(rows, quart, few).selectExpr("grp", "total", *x, f"explode(CASE WHEN greatest({near}) <= 2.5D THEN array('a', 'b') ELSE array('b') END) AS start")
    params = materialize(_solve(_narrow(_sums(begun), few), 1.0), "starts")
    drop(spark, quart)
    settled: list[DataFrame] = []
    while not params.isEmpty():
        far = _meet(rows, params, few).selectExpr("grp", "start", "salt", "total", *x, f"{_DISTANCE} AS distance")
        cut = _narrow(far.groupBy("grp", "start").agg(F.expr(f"percentile_approx(distance, {share}D, 2000) AS cut")), few)
        new = _solve(_narrow(_sums(_meet(far, cut, few, "grp", "start").filter("distance <= cut")), few), share)
        old = params.selectExpr("grp", "start", "fit AS old")
        both = new.join(F.broadcast(old) if few else old, ["grp", "start"])
        # quantiles of many rows are near ones only: a step counts where it leads down
        fell = f"fit.det < old.det - {STILL}D"
        step = materialize(both.selectExpr("grp", "start", "total", f"CASE WHEN {fell} THEN fit ELSE old END AS fit", f"{fell} AS moves"), "steps")
        settled.append(step.filter("NOT moves"))
        params = step.filter("moves")
    out = settled[0] if settled else params
    for t in settled[1:]:
        out = out.unionByName(t)
    return out.groupBy("grp").agg(F.max("total").alias("total"), F.expr("min_by(fit, struct(fit.det, start)) AS fit"))


def _pooled(params: DataFrame, groups: DataFrame, prior: float) -> DataFrame:
    """grp and its fit after shrinking: of each (grp, tongue) in groups, by its language's and all rows' estimates."""
    few = params.count() <= FEW

    def level(p: str) -> DataFrame:
        out = params.selectExpr(f"grp AS {p}_grp", f"total AS {p}_n", f"fit AS {p}_fit")
        return F.broadcast(out) if few else out

    groups = _narrow(groups, few)
    one = groups.join(level("s"), F.expr("grp = s_grp")).join(level("l"), F.expr("tongue = l_grp"))
    # not a literal, which would leave a join without keys
    one = one.join(level("w"), F.expr("concat(substring(grp, 1, 0), 'A') = w_grp"))

    def run(frames):
        for f in frames:
            fits = []
            for n, k, own, tongue, whole in zip(*(f[c] for c in ("s_n", "l_n", "s_fit", "l_fit", "w_fit")), strict=True):
                at = [(np.asarray(x["m"], float), _square(x["c"])) for x in (own, tongue, whole)]
                m, c = shrunk(n, *at[0], *shrunk(k, *at[1], *at[2], prior), prior)
                fits.append({"det": float(np.linalg.slogdet(c)[1]), "m": m.tolist(), "c": _lower(c), "v": _lower(np.linalg.inv(c))})
            yield pd.DataFrame({"grp": f["grp"], "fit": pd.Series(fits, dtype=object)})

    return one.mapInPandas(run, f"grp string, fit {_FIT}")


def _judged(rows: DataFrame, params: DataFrame, tail: float) -> DataFrame:
    """rows of vectors() with base_failed, distance and kept."""
    out = _meet(rows, params, params.count() <= FEW).withColumn("distance", F.expr(_DISTANCE))
    return out.withColumn("base_failed", F.expr(LIMITS)).withColumn("kept", F.expr(f"NOT base_failed AND distance <= {chi2_tail(tail, P)}D"))


def _learned(docs: DataFrame, share: float, prior: float) -> tuple[DataFrame, DataFrame]:
    """Stored vectors of docs, and their groups' estimates."""
    stats = materialize(vectors(statistics(pick(docs, "doc_id", "text", "lang", "source"), "lang", "source")), "stats")
    levels = stats.select(F.explode(F.array(F.col("grp"), F.col("tongue"), F.lit("A"))).alias("grp"), "salt", *VECTOR)
    fits = materialize(estimates(levels, share), "fits")
    params = materialize(_pooled(fits, stats.select("grp", "tongue").distinct(), prior), "estimates")
    return stats, params


def judge(docs: DataFrame, share: float = SHARE, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (squared), kept."""
    out = _judged(*_learned(docs, share, prior), tail)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def kept(docs: DataFrame, share: float = SHARE, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """The rows of docs that judge() keeps, whatever their doc_ids: each row's statistics are counted again beside it."""
    stats, params = _learned(docs, share, prior)
    drop(docs.sparkSession, stats)
    names = [c for c in docs.columns if c not in ("doc_id", "text")] + ["whole"]
    rows = vectors(statistics(docs.withColumn("whole", F.col("text")), *names))
    return _judged(rows, params, tail).filter("kept").withColumnRenamed("whole", "text").select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs)
