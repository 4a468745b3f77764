"""Disproportionality: 2x2 tables of report designs and events, measures, criteria, and the empirical-Bayes prior."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.sources.files import stored

Z = 1.959963984540054


def with_events(reports: DataFrame, flags: list[str]) -> DataFrame:
    """reports, a row for each of their flag columns: event (the flag's name) and present. Where flags stand in the reports' own rows, this takes no join."""
    rest = [c for c in reports.columns if c not in flags]
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).alias("present")) for e in flags]))
    return reports.select(*rest, each.alias("_e")).select(*rest, "_e.event", "_e.present")


def two_by_two(members: DataFrame, events: DataFrame) -> DataFrame:
    """design, event, a, b, c, d, expected from members(record_id, design, target) and events(record_id, event, present). Unknown counts as absent. A record may be in several designs."""
    return two_by_two_of(members.join(events, "record_id"))


def two_by_two_of(m: DataFrame) -> DataFrame:
    """As two_by_two, from rows that hold design, target, event and present already."""
    hit, t = F.coalesce("present", F.lit(False)), F.col("target")
    out = m.groupBy("design", "event").agg(F.count_if(t & hit).alias("a"), F.count_if(t & ~hit).alias("b"), F.count_if(~t & hit).alias("c"), F.count_if(~t & ~hit).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return out.withColumn("expected", (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / n)


def _cells(add: Column) -> list[Column]:
    return [F.col(c) + F.when(add, 0.5).otherwise(0.0) for c in "abcd"]


def ror() -> dict[str, Column]:
    a, b, c, d = _cells(F.least("a", "b", "c", "d") == 0)
    x, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"ror": F.exp(x), "ror_low": F.exp(x - Z * se), "ror_high": F.exp(x + Z * se)}


def prr() -> dict[str, Column]:
    a, b, c, d = _cells((F.col("a") == 0) | (F.col("c") == 0))
    x = F.log((a / (a + b)) / (c / (c + d)))
    se = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    p, q, r, s = (F.col(k).cast("double") for k in "abcd")
    n, den = p + q + r + s, (p + q) * (r + s) * (p + r) * (q + s)
    chi2 = F.when(den == 0, 0.0).otherwise(n * F.pow(F.greatest(F.abs(p * s - q * r) - n / 2, F.lit(0.0)), F.lit(2.0)) / den)
    return {"prr": F.exp(x), "prr_low": F.exp(x - Z * se), "prr_high": F.exp(x + Z * se), "chi2": chi2}


def information(limits: bool = False) -> dict[str, Column]:
    out = {"ic": F.log2((F.col("a") + 0.5) / (F.col("expected") + 0.5))}
    if limits:
        q = lambda p: F.log2(S.column(lambda a, e, p=p: S.gamma_quantile(p, a + 0.5, e + 0.5), "a", "expected"))
        out |= {"ic025": q(0.025), "ic975": q(0.975)}
    return out


def fdr(df: DataFrame, p: str, family: list[str], out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg within families; unknown p-values stay unknown and don't count."""
    known = df.where(F.col(p).isNotNull())
    up = Window.partitionBy(*family).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    ranked = known.withColumn("_r", F.row_number().over(up)).withColumn("_q", F.col(p) * m / F.col("_r"))
    down = Window.partitionBy(*family).orderBy(F.desc("_r"))
    done = ranked.withColumn(out, F.least(F.lit(1.0), F.min("_q").over(down))).drop("_r", "_q")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def criteria(primary: str = "ic", least: int = 3, shrunk: bool = False) -> dict[str, Column]:
    """Which measures call a signal; needs ror_low, prr, chi2, ic025 and, if shrunk, eb05."""
    false = lambda c: F.coalesce(c, F.lit(False))
    enough = F.col("a") >= least
    out = {"signal_ror": false(enough & (F.col("ror_low") > 1)), "signal_prr": false(enough & (F.col("prr") >= 2) & (F.col("chi2") >= 4)), "signal_ic": false(F.col("ic025") > 0)}
    out |= {"signal_ebgm": false(F.col("eb05") >= 2)} if shrunk else {}
    met = sum((c.cast("int") for c in list(out.values())[1:]), list(out.values())[0].cast("int"))
    return out | {"n_met": met, "signal_primary": enough & (out[f"signal_{primary}"] if primary != "consensus2" else met >= 2)}


def product_event_counts(administrations: DataFrame, events: DataFrame) -> DataFrame:
    """vaccine, event, n, expected over the full grid: distinct (record, vaccine) with the event; expected from the margins."""
    adm = administrations.select("record_id", "vaccine").distinct()
    hit = adm.join(events.where("present"), "record_id").groupBy("vaccine", "event").agg(F.count(F.lit(1)).alias("n"))
    return _grid(hit, administrations.select("vaccine").distinct(), events.select("event").distinct())


def product_event_counts_of(reports: DataFrame, vaccines: str, flags: list[str]) -> DataFrame:
    """As product_event_counts, from reports of one row each: their array of vaccines (a repeated one counts once) and their flags of events. Tasks count their own rows; nothing but counts is shuffled, and no report meets another."""
    each = reports.select(F.explode(F.array_distinct(vaccines)).alias("vaccine"), *flags)
    found = each.groupBy("vaccine").agg(*[F.count_if(e).alias(e) for e in flags])
    return _expected(found.unpivot(["vaccine"], flags, "event", "n"))


def _grid(hit: DataFrame, vaccines: DataFrame, kinds: DataFrame) -> DataFrame:
    grid = vaccines.crossJoin(F.broadcast(kinds)).join(hit, ["vaccine", "event"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # products x events: two short lists
    return _expected(grid)


def _expected(grid: DataFrame) -> DataFrame:
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    return grid.withColumn("expected", w("vaccine") * w("event") / w(F.lit(1)))


def cumulative_ic(members: DataFrame, events: DataFrame) -> DataFrame:
    """event, year, a, b, c, d and ic on all data up to each year: yearly counts, then running sums. members(record_id, target, year)."""
    return cumulative_ic_of(members.join(events, "record_id"))


def cumulative_ic_of(m: DataFrame) -> DataFrame:
    """As cumulative_ic, from rows that hold target, year, event and present already."""
    hit, t = F.coalesce("present", F.lit(False)), F.col("target")
    yearly = m.groupBy("event", "year").agg(F.count_if(t & hit).alias("a"), F.count_if(t & ~hit).alias("b"), F.count_if(~t & hit).alias("c"), F.count_if(~t & ~hit).alias("d"))
    w = Window.partitionBy("event").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    run = yearly.select("event", "year", *[F.sum(k).over(w).alias(k) for k in "abcd"])
    e = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / (F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    return run.withColumn("ic", F.log2((F.col("a") + 0.5) / (e + 0.5)))


def cooccurrence(events: DataFrame, least_share: float = 0.01) -> DataFrame:
    """x, y (x < y), n11, log_or: pairs of events of one record, with half a count added to each cell. A record has a bounded number of events."""
    n = events.select(F.countDistinct("record_id")).scalar()
    known = events.where("present").select("record_id", "event")
    single = known.groupBy("event").agg(F.count(F.lit(1)).alias("n1")).withColumn("total", n).where(F.col("n1") >= least_share * F.col("total"))
    pairs = known.alias("l").join(known.alias("r"), F.expr("l.record_id = r.record_id and l.event < r.event")).groupBy(F.col("l.event").alias("x"), F.col("r.event").alias("y")).agg(F.count(F.lit(1)).alias("n11"))
    x, y = (single.select(F.col("event").alias(k), F.col("n1").alias(f"n_{k}"), F.col("total").alias(f"t_{k}")) for k in "xy")
    d = pairs.join(x, "x").join(y, "y")
    n10, n01 = F.col("n_x") - F.col("n11"), F.col("n_y") - F.col("n11")
    n00 = F.col("t_x") - F.col("n_x") - F.col("n_y") + F.col("n11")
    return d.select("x", "y", "n11", F.log((F.col("n11") + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))).alias("log_or"))


class Prior(NamedTuple):
    """Two gamma distributions of n / expected (shape, rate), the weight of the first, whether the fit settled, and its log likelihood."""

    a1: float
    b1: float
    a2: float
    b2: float
    weight: float
    converged: bool
    log_likelihood: float


STARTS = ((0.2, 0.1, 2.0, 4.0, 1 / 3), (0.5, 0.5, 5.0, 5.0, 0.2), (1.0, 1.0, 3.0, 1.0, 0.5))


def _negative_binomial(n: np.ndarray, e: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of counts n at expected e under a gamma prior, with first (rows x 2) and second (rows x 2 x 2) derivatives by the logarithms of a and b."""
    value = S.lgamma(a + n) - math.lgamma(a) - S.lgamma(n + 1) + a * np.log(b / (b + e)) + n * np.log(e / (b + e))
    one = np.full_like(n, a)
    da, db = S.digamma(n + a) - S.digamma(one) + np.log(b / (b + e)), a / b - (a + n) / (b + e)
    daa, dab, dbb = S.trigamma(n + a) - S.trigamma(one), 1 / b - 1 / (b + e), (a + n) / (b + e) ** 2 - a / b**2
    first = np.column_stack([a * da, b * db])
    second = np.empty((len(n), 2, 2))
    second[:, 0, 0], second[:, 1, 1] = a * a * daa + a * da, b * b * dbb + b * db
    second[:, 0, 1] = second[:, 1, 0] = a * b * dab
    return value, first, second


def fit_prior(cells: DataFrame, starts: tuple = STARTS, steps: int = 60, tolerance: float = 1e-8) -> Prior:
    """The likeliest mixture of two gamma distributions of n / expected, from several starts.

    Newton's method on the logarithms of shapes and rates and the log odds of the
    weight: one pass over the distinct cells gives, for all starts at once, the log
    likelihood with its first and second derivatives, 31 numbers a start. Directions in
    which the surface isn't concave are climbed by their absolute curvature, and a
    step that loses likelihood is halved. The best start wins; converged says that
    its last two steps gained nothing. Cells with expected 0 say nothing.
    """
    d = stored(cells.where("expected > 0").groupBy("n", "expected").agg(F.count(F.lit(1)).cast("double").alias("k")))

    def measured(points: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(points), 31))
            for batch in batches:
                n, e, k = (batch.column(c).to_numpy().astype(float) for c in ("n", "expected", "k"))
                for i, t in enumerate(points if len(n) else ()):
                    a1, b1, a2, b2 = np.exp(t[:4])
                    w = 1 / (1 + math.exp(-t[4]))
                    (l1, g1, h1), (l2, g2, h2) = _negative_binomial(n, e, a1, b1), _negative_binomial(n, e, a2, b2)
                    both = np.logaddexp(math.log(w) + l1, math.log1p(-w) + l2)
                    r = np.exp(math.log(w) + l1 - both)
                    g = np.column_stack([r[:, None] * g1, (1 - r)[:, None] * g2, r - w])
                    u = np.column_stack([g1, -g2, np.ones(len(n))])  # how the log odds of the first component change
                    h = (u * (k * r * (1 - r))[:, None]).T @ u
                    h[:2, :2] += np.einsum("i,ijk->jk", k * r, h1)
                    h[2:4, 2:4] += np.einsum("i,ijk->jk", k * (1 - r), h2)
                    h[4, 4] -= k.sum() * w * (1 - w)
                    total[i] += np.concatenate([[k @ both], k @ g, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

        out = np.zeros(len(points) * 31)
        for row in d.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[row.i] = row.v
        return out.reshape(len(points), 31)

    at = [np.array([*np.log(s[:4]), math.log(s[4] / (1 - s[4]))]) for s in starts]
    here, moves, settled, small = measured(at), [np.zeros(5)] * len(at), [False] * len(at), [0] * len(at)
    for i, m in enumerate(here):
        moves[i] = _uphill(m)
    for _ in range(steps):
        trial = [np.clip(t + s, -15, 15) for t, s in zip(at, moves, strict=True)]
        seen = measured(trial)
        for i, m in enumerate(seen):
            if settled[i]:
                continue
            gain = m[0] - here[i, 0]
            if np.isfinite(m).all() and gain >= 0:
                small[i] = small[i] + 1 if gain < tolerance * max(1.0, abs(m[0])) else 0
                settled[i] = small[i] >= 2
                at[i], here[i] = trial[i], m
                moves[i] = _uphill(m)
            else:
                moves[i] = moves[i] / 2
                settled[i] = bool(abs(moves[i]).max() < 1e-9)
        if all(settled):
            break
    best = int(np.argmax(here[:, 0]))
    a1, b1, a2, b2 = (float(v) for v in np.exp(at[best][:4]))
    return Prior(a1, b1, a2, b2, float(1 / (1 + math.exp(-at[best][4]))), settled[best], float(here[best, 0]))


def _uphill(m: np.ndarray, most: float = 1.0) -> np.ndarray:
    """A step by the derivatives in m, at most `most` long in each direction."""
    curve, axes = np.linalg.eigh(m[6:].reshape(5, 5))
    step = axes @ ((axes.T @ m[1:6]) / np.maximum(np.abs(curve), 1e-8 * max(1.0, np.abs(curve).max())))
    return step * min(1.0, most / max(np.abs(step).max(), 1e-12))


def shrunk(cells: DataFrame, prior: tuple) -> DataFrame:
    """cells with ebgm, eb05 and eb95 under the prior."""
    a1, b1, a2, b2, w = prior[:5]

    def weight(n, e):
        part = lambda a, b: S.lgamma(n + a) - math.lgamma(a) + a * np.log(b / (b + e)) + n * np.log(e / (b + e))
        return 1 / (1 + (1 - w) / w * np.exp(np.clip(part(a2, b2) - part(a1, b1), -700, 700)))

    def mean(n, e):
        q = weight(n, e)
        return np.exp(q * (S.digamma(n + a1) - np.log(e + b1)) + (1 - q) * (S.digamma(n + a2) - np.log(e + b2)))

    def at(p):
        def f(n, e):
            q = weight(n, e)
            return S.quantile(lambda x: q * S.gamma_cdf(x * (e + b1), n + a1) + (1 - q) * S.gamma_cdf(x * (e + b2), n + a2), np.full(len(n), p), 0.0, 10.0)

        return f

    return cells.withColumns({"ebgm": S.column(mean, "n", "expected"), "eb05": S.column(at(0.05), "n", "expected"), "eb95": S.column(at(0.95), "n", "expected")})
