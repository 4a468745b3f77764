"""Multivariate monitoring: robust location and scatter, principal components, T2 and SPE with their limits and contributions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.operators.measures import exact_quantiles
from siglot.sources.files import stored


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of the rows without unknowns, from one aggregation of shifted products."""
    p = len(columns)
    shift = df.agg(*[F.avg(c) for c in columns]).first()
    x = [F.col(c).cast("double") - F.lit(float(m or 0.0)) for c, m in zip(columns, shift, strict=True)]
    got = df.agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]).first()
    n, s = got[0], np.array(got[1 : p + 1], float)
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = got[p + 1 :]
    cov = cov + np.triu(cov, 1).T
    return n, np.array(shift, float) + s / n, (cov - np.outer(s, s) / n) / (n - 1)


def distance2(columns: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """The squared Mahalanobis distance."""
    inverse = np.linalg.pinv(cov)
    x = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    out = F.lit(0.0)
    for i, a in enumerate(x):
        inner = F.lit(0.0)
        for j, b in enumerate(x):
            inner = inner + float(inverse[i, j]) * b
        out = out + a * inner
    return out


def robust_moments(df: DataFrame, columns: list[str], share: float = 0.5, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) by the minimum covariance determinant.

    From medians and median deviations, each step keeps the `share` of rows nearest by
    the distance so far and takes their mean and covariance, which never enlarges the
    determinant, until it stands. The covariance is then scaled so that the median
    distance is that of normal data, and the rows within the 97.5 % distance give the
    result. A step is a narrowed exact quantile and an aggregation over all rows.
    """
    df = stored(df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*columns))
    p = len(columns)
    n = df.count()
    share = max(share, (n + p + 1) / (2 * n))
    mid = np.array([exact_quantiles(df, c, [0.5])[0] for c in columns], float)
    spread = [exact_quantiles(df.select(F.abs(F.col(c) - float(m)).alias("v")), "v", [0.5])[0] for c, m in zip(columns, mid, strict=True)]
    mean, cov, before = mid, np.diag([max(1.4826 * s, 1e-9) ** 2 for s in spread]), math.inf
    for _ in range(steps):
        d = df.withColumn("_d", distance2(columns, mean, cov))
        cut = exact_quantiles(d.select("_d"), "_d", [share])[0]
        _, mean, cov = moments(d.where(F.col("_d") <= cut), columns)
        det = float(np.linalg.slogdet(cov)[1])
        if abs(det - before) < 1e-9:
            break
        before = det
    d = df.withColumn("_d", distance2(columns, mean, cov))
    middle = exact_quantiles(d.select("_d"), "_d", [0.5])[0]
    cov = cov * middle / float(S.chi2_quantile(0.5, p))
    near = df.where(distance2(columns, mean, cov) < float(S.chi2_quantile(0.975, p)))
    _, mean, cov = moments(near, columns)
    return mean, cov


@dataclass
class Monitor:
    """A principal-component model of p attributes: a components hold the target share of the variance."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray  # eigenvalues, the largest first
    vectors: np.ndarray
    a: int
    t2_limit: float
    spe_limit: float

    def scores(self, df: DataFrame) -> DataFrame:
        """df with t2, spe, t2_flag, spe_flag and contributions (array, in the order of the columns, adding up to t2); null where an attribute is."""
        z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        df = df.withColumn("_z", F.array(*z))
        at = lambda j: F.get("_z", F.lit(j))
        p = len(z)
        t = [sum((float(self.vectors[j, k]) * at(j) for j in range(1, p)), float(self.vectors[0, k]) * at(0)) for k in range(self.a)]
        df = df.withColumn("_t", F.array(*t))
        of = lambda k: F.get("_t", F.lit(k))
        parts = [sum((float(self.vectors[j, k] / self.values[k]) * of(k) * at(j) for k in range(1, self.a)), float(self.vectors[j, 0] / self.values[0]) * of(0) * at(j)) for j in range(p)]
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
        df = df.withColumn("contributions", F.array(*parts)).withColumn("t2", F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x))
        df = df.withColumn("spe", F.greatest(F.lit(0.0), total("_z") - total("_t")))
        return df.withColumns({"t2_flag": F.col("t2") > self.t2_limit, "spe_flag": F.col("spe") > self.spe_limit}).drop("_z", "_t")


def normal_quantile(p: float) -> float:
    return float(S.t_quantile(np.array([p]), np.array([1e9]))[0])


def residual_limit(values: np.ndarray, alpha: float) -> float:
    """Of the squared prediction error, from the eigenvalues left out: the cube-root-like normal approximation, or a scaled chi-square where its exponent isn't positive."""
    t1, t2, t3 = (float((values**k).sum()) for k in (1, 2, 3))
    if t1 <= 0 or t2 <= 0:
        return 0.0
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    if h <= 0:
        return t2 / t1 * float(S.chi2_quantile(1 - alpha, t1 * t1 / t2))
    c = normal_quantile(1 - alpha)
    return t1 * (c * math.sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / (t1 * t1)) ** (1 / h)


def fit_monitor(df: DataFrame, columns: list[str], alpha: float = 0.01, variance: float = 0.85, robust: bool = True) -> Monitor:
    """The components of the (robust) correlation matrix; only p x p numbers reach the driver."""
    df = df.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns))
    n, mean, cov = moments(df, columns)
    if robust:
        mean, cov = robust_moments(df, columns)
    scale = np.sqrt(np.diag(cov))
    scale[scale <= 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values, vectors = np.clip(values[::-1], 1e-12, None), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))] < 0, -1, 1)
    p = len(columns)
    a = max(1, min(int(np.searchsorted(np.cumsum(values) / values.sum(), variance)) + 1, max(1, p - 1)))
    t2 = (n - 1) ** 2 / n * float(S.beta_quantile(np.array([1 - alpha]), np.array([a / 2]), np.array([(n - a - 1) / 2]))[0])
    return Monitor(columns, mean, scale, values, vectors, a, t2, residual_limit(values[a:], alpha))


def flagged_by(scores: DataFrame, by: str) -> DataFrame:
    """by, n_lots, t2_flagged, spe_flagged of Monitor.scores()."""
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n_lots"), F.count_if("t2_flag").alias("t2_flagged"), F.count_if("spe_flag").alias("spe_flagged"))


def top_contributors(scores: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """attribute, n_flagged, n: in how many of the flagged lots an attribute is among the k largest contributions by size, equal ones in the order of the columns; attributes that never are have n = 0."""
    flagged = scores.where("(t2_flag or spe_flag) and contributions is not null")
    ranked = F.array_sort(F.transform("contributions", lambda c, i: F.struct((-F.abs(c)).alias("size"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, k), lambda x: x["i"])
    counts = flagged.select(top.alias("top")).agg(F.count(F.lit(1)).alias("n_flagged"), *[F.count_if(F.array_contains("top", i)).alias(c) for i, c in enumerate(columns)])
    return counts.unpivot(["n_flagged"], columns, "attribute", "n")
