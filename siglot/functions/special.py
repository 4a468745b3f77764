"""Special functions as vectorised columns: gamma and beta functions, their inverses, and the distributions built on them. Meant for aggregated tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

def lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))


def gamma_cdf(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series for small x, a continued fraction beyond."""
    x, a = np.broadcast_arrays(np.maximum(np.asarray(x, float), 0), np.asarray(a, float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma(a))
        term = total = 1 / a
        for n in range(1, 600):
            term = term * x / (a + n)
            total = total + term
            if (np.abs(term) < 1e-17 * np.abs(total)).all():
                break
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d
        for n in range(1, 600):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where((t := an * d + b) == 0, 1e-300, t)
            c = np.where((t := b + an / c) == 0, 1e-300, t)
            h = h * d * c
        return np.where(x <= 0, 0.0, np.where(x < a + 1, np.minimum(front * total, 1.0), np.clip(1 - front * h, 0.0, 1.0)))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.clip(np.asarray(x, float), 0, 1), np.asarray(a, float), np.asarray(b, float))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 / (1 - (p + q) * y / (p + 1))
        h = d
        for m in range(1, 400):
            for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                h = h * d * c
        v = np.clip(front * h, 0.0, 1.0)
    v = np.where(y <= 0, 0.0, v)
    return np.where(turn, 1 - v, v)


def quantile(cdf: Callable, p: np.ndarray, low: float, high: np.ndarray) -> np.ndarray:
    """x with cdf(x) = p, by bisection to the last bits; high is doubled until it lies beyond."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, low), np.array(np.broadcast_to(high, p.shape), float)
    for _ in range(200):
        short = cdf(hi) < p
        if not short.any():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(100):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def gamma_quantile(p, a, rate=1.0) -> np.ndarray:
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float))
    return quantile(lambda x: gamma_cdf(x, a), p, 0.0, a + 10) / rate


def chi2_quantile(p, df) -> np.ndarray:
    return 2 * gamma_quantile(p, np.asarray(df, float) / 2)


def chi2_sf(x, df) -> np.ndarray:
    return 1 - gamma_cdf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def t_cdf(t, df) -> np.ndarray:
    t = np.asarray(t, float)
    tail = beta_cdf(df / (df + t * t), np.asarray(df, float) / 2, 0.5) / 2
    return np.where(t > 0, 1 - tail, tail)


def t_quantile(p, df) -> np.ndarray:
    p = np.asarray(p, float)
    x = quantile(lambda v: t_cdf(v, df), np.where(p < 0.5, 1 - p, p), 0.0, 10.0)
    return np.where(p < 0.5, -x, x)


def beta_quantile(p, a, b) -> np.ndarray:
    return quantile(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def normal_sf(z) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(z)


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """The sum of the probabilities of all tables with the same margins that are no likelier than the one seen."""

    def one(a: int, b: int, c: int, d: int) -> float:
        r, k, n = a + b, a + c, a + b + c + d
        x = np.arange(max(0, r + k - n), min(r, k) + 1)
        p = lgamma(np.array([r, k, n - r, n - k]) + 1.0).sum() - lgamma(np.array([n]) + 1.0) - lgamma(x + 1.0) - lgamma(r - x + 1.0) - lgamma(k - x + 1.0) - lgamma(n - r - k + x + 1.0)
        p = np.exp(p)
        return float(min(1.0, p[p <= p[a - x[0]] * (1 + 1e-7)].sum()))

    return np.array([one(*map(int, v)) for v in zip(a, b, c, d, strict=True)])


def column(f: Callable, *cols):
    """f, which takes and gives numpy arrays, as a column of doubles; unknown in any argument is unknown."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            x = np.column_stack([p.to_numpy(float) for p in (parts if isinstance(parts, tuple) else (parts,))])
            ok = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if ok.any():
                out[ok] = f(*x[ok].T)
            yield pd.Series(out)

    given = Iterator[pd.Series] if len(cols) == 1 else Iterator[tuple[pd.Series, ...]]
    run.__annotations__ = {"batches": given, "return": Iterator[pd.Series]}
    return F.nanvl(F.pandas_udf(run, "double")(*cols), F.lit(None).cast("double"))
