"""Overdispersed counts of short series: negative-binomial trends and interrupted series, one series per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglot.functions import special as S

Z = 1.959963984540054


def negative_binomial(x: np.ndarray, y: np.ndarray, offset: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, their covariance, alpha, log likelihood) with variance m + alpha m^2: coefficients by scoring for each alpha, alpha by the profile likelihood."""

    def fit(alpha: float, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        for _ in range(steps):
            m = np.exp(np.clip(x @ b + offset, -30, 30))
            w = m / (1 + alpha * m)
            step = np.linalg.pinv((x * w[:, None]).T @ x) @ (x.T @ (w * (y - m) / m))
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            b = b + step
            if np.abs(step).max() < 1e-10:
                break
        m = np.exp(np.clip(x @ b + offset, -30, 30))
        r = 1 / alpha
        log = S.lgamma(y + r) - S.lgamma(np.full(len(y), r)) - S.lgamma(y + 1) - r * np.log1p(alpha * m) + y * np.log(alpha * m / (1 + alpha * m))
        return b, m, float(log.sum())

    b = np.zeros(x.shape[1])
    b[0] = np.log(max(y.sum(), 0.5)) - np.log(np.exp(offset).sum())
    low, high, gold = np.log(1e-8), np.log(50.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-7:  # golden section in log alpha
        u, v = high - gold * (high - low), low + gold * (high - low)
        if fit(np.exp(u), b)[2] >= fit(np.exp(v), b)[2]:
            high = v
        else:
            low = u
    alpha = float(np.exp((low + high) / 2))
    b, m, log = fit(alpha, b)
    return b, np.linalg.pinv((x * (m / (1 + alpha * m))[:, None]).T @ x), alpha, log


TERMS = "term string, estimate double, rate_ratio double, low double, high double, alpha double, n int"


def count_models(df: DataFrame, series: str, y: str, terms: dict[str, Column], exposure: str | None = None) -> DataFrame:
    """series and TERMS: a negative-binomial fit of each series. A series is one group: years or months of one product, not rows of data."""
    kind = df.schema[series].dataType.simpleString()
    names, n_terms = ["intercept", *terms], len(terms)
    cols = [F.col(series).alias("series"), F.col(y).cast("double").alias("y"), (F.log(exposure) if exposure else F.lit(0.0)).alias("o"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())]]
    d = df.select(*cols).where("y is not null and y >= 0 and o is not null")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), *[pdf[f"x{i}"].to_numpy() for i in range(n_terms)]])
        if len(pdf) <= len(names) or not pdf["y"].sum():
            return pd.DataFrame({"series": pdf["series"].iloc[:1], "term": ["not estimable"], "estimate": [None], "rate_ratio": [None], "low": [None], "high": [None], "alpha": [None], "n": [len(pdf)]})
        b, cov, alpha, _ = negative_binomial(x, pdf["y"].to_numpy(), pdf["o"].to_numpy())
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]] * len(b), "term": names, "estimate": b, "rate_ratio": np.exp(b), "low": np.exp(b - Z * se), "high": np.exp(b + Z * se), "alpha": alpha, "n": len(pdf)})

    return d.groupBy("series").applyInPandas(fit, f"series {kind}, {TERMS}").withColumnRenamed("series", series)


def interrupted(year: Column, start: int, end: int) -> dict[str, Column]:
    """Terms of an interrupted series: the trend before, the years of transition, and level and slope after them."""
    post = (year > end).cast("double")
    return {"time": year - start, "transition": year.between(start, end).cast("double"), "post": post, "time_post": (year - end) * post}
