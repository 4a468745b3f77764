"""Descriptive tables, rates and trends, change points, process-quality statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siglot.functions import special as S
from siglot.sources.files import stored

Z = 1.959963984540054


def characteristics(df: DataFrame, variables: list[str], group: str) -> DataFrame:
    """variable, level, grp (with 'All'), n, denominator, pct; unknown is a level."""
    long = df.select(group, *[F.coalesce(F.col(v).cast("string"), F.lit("missing")).alias(v) for v in variables]).unpivot([group], variables, "variable", "level")
    n = long.groupBy("variable", "level", group).agg(F.count(F.lit(1)).alias("n"))
    every = n.groupBy("variable", "level").agg(F.sum("n").alias("n")).withColumn("grp", F.lit("All"))
    both = n.withColumn("grp", F.col(group).cast("string")).drop(group).unionByName(every)
    out = both.withColumn("denominator", F.sum("n").over(Window.partitionBy("variable", "grp")))
    return out.select("variable", "level", "grp", "n", "denominator", F.round(100.0 * F.col("n") / F.col("denominator"), 4).alias("pct"))


def summary(df: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    """group, n, mean, sd, min, q1, median, q3, p90, max."""
    names = ["q1", "median", "q3", "p90"]
    plain = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, group, value, [0.25, 0.5, 0.75, 0.9]).select(group, *[F.round(F.get("q", F.lit(i)), digits).alias(c) for i, c in enumerate(names)])
    return plain.join(q, F.col("_g").eqNullSafe(F.col(group))).select(group, "n", "mean", "sd", "min", *names, "max")


def crosstab_chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof of independence, with Yates' correction for 2 x 2 only."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = n.groupBy(a).agg(F.sum("n").alias("r")), n.groupBy(b).agg(F.sum("n").alias("c"))
    total = n.select(F.sum("n")).scalar()
    grid = rows.crossJoin(F.broadcast(cols)).join(n, [a, b], "left").withColumn("t", total)  # levels of two categories
    e = F.col("r") * F.col("c") / F.col("t")
    g = grid.withColumns({"e": e, "d": F.abs(F.coalesce("n", F.lit(0)) - e)})
    s = g.agg(F.countDistinct(a).alias("k"), F.countDistinct(b).alias("l"), F.sum(F.pow("d", F.lit(2)) / F.col("e")).alias("plain"), F.sum(F.pow(F.col("d") - F.least(F.lit(0.5), "d"), F.lit(2)) / F.col("e")).alias("yates"))
    return s.select(F.when((F.col("k") == 2) & (F.col("l") == 2), F.col("yates")).otherwise(F.col("plain")).alias("chi2"), ((F.col("k") - 1) * (F.col("l") - 1)).alias("dof"))


def average_rank(value: Column, *by: str) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def total_before(df: DataFrame, value: str, amounts: list[str], *by: str, parts: int = 128) -> DataFrame:
    """df with, for each amount, its sum over the smaller values of the same group (<amount>_before) and over the whole group (<amount>_all); values are distinct in their group. df is read twice, so it should be a stored table.

    Values are dealt to ranges between quantiles of the whole column, the ranges' totals
    run over at most `parts` rows a group, and a window runs inside each range, so that
    no task holds a whole column.
    """
    edges = df.select(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10_000))).first()[0] or []
    edges = sorted(set(edges))

    def part(low: int, high: int) -> Column:
        """How many edges are smaller, between low and high, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(value) > F.lit(edges[mid]), part(mid + 1, high)).otherwise(part(low, mid))

    d = df.withColumn("_part", part(0, len(edges)))
    every, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in amounts])
    base = base.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in amounts], *[F.sum(f"_sum_{c}").over(every).alias(f"{c}_all") for c in amounts])
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(base, [*by, "_part"]).withColumns({f"{c}_before": F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in amounts})
    return out.drop("_part", *[f"_base_{c}" for c in amounts])


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, n, q (array): exact quantiles of the known values, interpolated between neighbours, null where a group has none.

    Equal values are counted before they move, and ranks come from ranges of values, so
    no task holds a group's values.
    """
    per = stored(df.groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(value).alias("n")))
    known = total_before(per.where("v is not null").withColumn("g", F.struct(group)), "v", ["n"], "g")  # a struct keeps the null group joinable
    sides = [(p, side) for p in shares for side in (F.floor, F.ceil)]
    rank = lambda p, side: side(p * (F.col("n_all") - 1))
    at = [F.max(F.when((F.col("n_before") <= rank(p, side)) & (rank(p, side) < F.col("n_before") + F.col("n")), F.col("v"))) for p, side in sides]
    found = known.groupBy("g").agg(F.max("n_all").alias("n_all"), *[c.alias(f"_q{i}") for i, c in enumerate(at)])
    between = lambda i, p: F.col(f"_q{2 * i}") + (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}")) * (p * (F.col("n_all") - 1) - rank(p, F.floor))
    q = found.select(F.col(f"g.{group}").alias("_of"), F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))
    groups = per.groupBy(group).agg(F.sum("n").alias("n"))
    return groups.join(q, groups[group].eqNullSafe(F.col("_of")), "left").select(group, "n", "q")


def exact_quantiles(df: DataFrame, value: str, shares: list[float], few: int = 50_000) -> list[float | None]:
    """Exact interpolated quantiles of one column's known values.

    Each share's neighbours are bracketed by approximate quantiles, the rows below a
    bracket are counted exactly, and the bracket narrows until it holds at most `few`
    distinct values, which alone are counted one by one. A pass is an aggregation.
    """
    v = F.col(value).cast("double")
    n, low, high = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(shares)
    out = []
    for p in shares:
        place, a, b, below = p * (n - 1), low, high, 0  # the wanted values lie in [a, b], with `below` rows under a
        wanted = (math.floor(place), math.ceil(place))
        inside = n
        while inside > few and a < b:
            lo, hi = (wanted[0] - below) / inside, (wanted[1] - below + 1) / inside
            near = df.where(v.between(a, b)).select(F.percentile_approx(v, F.array(F.lit(max(0.0, lo - 2e-3)), F.lit(min(1.0, hi + 2e-3))), F.lit(10_000))).first()[0]
            under, kept = df.agg(F.count_if(v < near[0]), F.count_if(v.between(near[0], near[1]))).first()
            if not (under <= wanted[0] and wanted[1] < under + kept) or kept >= inside:
                break  # ties hold the bracket together: few values are left, or many equal ones
            a, b, below, inside = near[0], near[1], under, kept
        rest = df.where(v.between(a, b))
        if inside <= few:
            ends = rest.agg(F.sort_array(F.collect_list(v)).alias("s")).select(*[F.get("s", F.lit(r - below)) for r in wanted]).first()
        else:
            counts = rest.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            ends = total_before(stored(counts), "v", ["n"]).agg(*[F.max(F.when((F.col("n_before") + below <= r) & (r < F.col("n_before") + below + F.col("n")), F.col("v"))) for r in wanted]).first()
        out.append(ends[0] + (ends[1] - ends[0]) * (place - wanted[0]))
    return out


def spearman(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, rho: correlation of average ranks. Equal rows are counted first; the ranks of both margins come from these counts, and no raw row is joined."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(group).isNotNull())
    per = stored(d.groupBy(F.col(group).alias("g"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))

    def ranks(c: str) -> DataFrame:
        """The rank less the mean rank of the group."""
        margin = total_before(stored(per.groupBy("g", c).agg(F.sum("n").alias("n"))), c, ["n"], "g")
        return margin.select("g", c, (F.col("n_before") + (F.col("n") - F.col("n_all")) / 2).alias(f"r{c}"))

    x, y, n = F.col("ra"), F.col("rb"), F.col("n")
    sums = per.join(ranks("a"), ["g", "a"]).join(ranks("b"), ["g", "b"]).groupBy("g").agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.select(F.col("g").alias(group), F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("rho"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = k / n, Z * Z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def garwood(k: Column) -> tuple[Column, Column]:
    """Exact Poisson limits."""
    low = S.column(lambda x: np.where(x == 0, 0.0, S.chi2_quantile(0.025, np.maximum(2 * x, 1)) / 2), k)
    return low, S.column(lambda x: S.chi2_quantile(0.975, 2 * x + 2) / 2, k)


def reporting_rates(counts: DataFrame, doses: DataFrame, year: str, partial: DataFrame, per: float = 1e5) -> DataFrame:
    """year, n, doses, rate: partial years keep their count but have no rate."""
    p = partial.select(year).withColumn("_partial", F.lit(True))
    d = counts.join(doses, year, "left").join(p, year, "left")
    return d.select(year, "n", "doses", F.when(F.col("_partial").isNull() & (F.col("doses") > 0), F.col("n") / F.col("doses") * per).alias("rate"))


def poisson_trend(df: DataFrame, x: str, n: str, exposure: str, steps: int = 25) -> dict[str, float]:
    """Log-linear trend of n / exposure in x: each Newton step is one aggregation; errors are scaled by the Pearson dispersion."""
    b = np.zeros(2)
    mid, total, e = df.agg(F.avg(x), F.sum(n), F.sum(exposure)).first()
    b[0] = np.log(total / e)
    d = df.select((F.col(x) - mid).alias("x"), F.col(n).cast("double").alias("y"), F.log(exposure).alias("o"))
    for _ in range(steps):
        m = F.exp(F.col("o") + b[0] + b[1] * F.col("x"))
        s = d.agg(F.sum(F.col("y") - m), F.sum((F.col("y") - m) * F.col("x")), F.sum(m), F.sum(m * F.col("x")), F.sum(m * F.col("x") * F.col("x")), F.sum(F.pow(F.col("y") - m, F.lit(2)) / m), F.count(F.lit(1))).first()
        info = np.array([[s[2], s[3]], [s[3], s[4]]])
        step = np.linalg.solve(info, s[:2])
        b += step
        if abs(step).max() < 1e-10:
            break
    phi = s[5] / max(1, s[6] - 2)
    se = float(np.sqrt(np.linalg.inv(info)[1, 1] * max(phi, 1e-12)))
    return {"rate_ratio": float(np.exp(b[1])), "low": float(np.exp(b[1] - Z * se)), "high": float(np.exp(b[1] + Z * se)), "dispersion": float(phi)}


def monthly_series(df: DataFrame, date: str) -> DataFrame:
    """month, n: every month from the first to the last, with zeros."""
    n = df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return grid.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def segment(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Starts of segments that minimise the squared error plus a penalty for each; starts that can't win any more are dropped."""
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        a = np.array([i for i in alive if t - i >= least])
        if not len(a):
            continue
        cost = best[a] + (q[t] - q[a]) - (s[t] - s[a]) ** 2 / (t - a)
        k = int(cost.argmin())
        best[t], back[t] = cost[k] + penalty, a[k]
        alive = [i for i in alive if t - i < least] + a[cost <= best[t]].tolist()
        if np.isfinite(best[t]):
            alive.append(t)
    cuts, t = [], n
    while t > 0:
        t = int(back[t])
        cuts.append(t)
    return cuts[::-1]


def change_points(df: DataFrame, series: str, order: str, value: str, penalty: float = 2.0, least: int = 10) -> DataFrame:
    """series, segment, start, length, mean for many series at once; the penalty is `penalty` ln n on values scaled by median and moving-range sigma. A series is one group, as its best cuts need all of it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        y = pdf["y"].to_numpy(float)
        sd = np.abs(np.diff(y)).mean() / 1.128 if len(y) > 1 else 0.0
        cuts = segment((y - np.median(y)) / (sd or 1.0), penalty * np.log(max(2, len(y))), least) or [0]
        ends = [*cuts[1:], len(y)]
        return pd.DataFrame({"series": pdf["series"].iloc[0], "segment": range(len(cuts)), "start": cuts, "length": [b - a for a, b in zip(cuts, ends, strict=True)], "mean": [y[a:b].mean() for a, b in zip(cuts, ends, strict=True)]})

    kind = df.schema[series].dataType.simpleString()
    d = df.where(F.col(value).isNotNull()).select(F.col(series).alias("series"), F.col(order).alias("at"), F.col(value).alias("y"))
    return d.groupBy("series").applyInPandas(run, f"series {kind}, segment int, start int, length int, mean double")


def best_split(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """series, n_before, gain: the one split that lowers the squared error most, from running sums inside parts of the whole order and over the parts' totals, so no task holds a series."""
    d = in_order(df.select(*series, *order, F.col(value).alias("_v")), series, order)
    every = Window.partitionBy(*series)
    earlier, inside = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*series, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = d.groupBy(*series, "_part").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_k"))
    parts = stored(parts.select(*series, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_k0"), F.sum("_s").over(every).alias("t"), F.sum("_k").over(every).alias("n")))
    own = d.select(*series, "_part", F.coalesce(F.sum("_v").over(inside), F.lit(0)).alias("s"), F.count("_v").over(inside).alias("k"))
    d = own.join(parts, [*series, "_part"]).withColumns({"s": F.col("s") + F.col("_s0"), "k": F.col("k") + F.col("_k0")}).where("k < n")
    gain = F.try_divide(F.col("s") * F.col("s"), F.col("k")) + F.pow(F.col("t") - F.col("s"), F.lit(2)) / (F.col("n") - F.col("k")) - F.col("t") * F.col("t") / F.col("n")
    return d.withColumn("gain", F.round(gain, 4)).groupBy(*series).agg(F.max_by("k", F.struct("gain", -F.col("k"))).alias("n_before"), F.max("gain").alias("gain"))


def capability(df: DataFrame, group: str, value: str, low: Column | None, high: Column | None) -> DataFrame:
    """group, n, mean, sd, ppk, pct_conforming; ppk from ten values on, infinite without spread."""
    sd, mean = F.stddev_samp(value), F.avg(value)
    sides = [(mean - low) / (3 * sd)] * (low is not None) + [(high - mean) / (3 * sd)] * (high is not None)
    ok = F.lit(True)
    for c in ([F.col(value) >= low] if low is not None else []) + ([F.col(value) <= high] if high is not None else []):
        ok = ok & c
    ppk = F.least(*sides) if len(sides) > 1 else sides[0]
    return df.groupBy(group).agg(F.count(value).alias("n"), mean.alias("mean"), sd.alias("sd"), F.when(F.count(value) >= 10, F.when(sd <= 0, F.lit(float("inf"))).otherwise(ppk)).alias("ppk"), (100.0 * F.count_if(ok) / F.count(value)).alias("pct_conforming"))


def individuals(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """df with i, centre, sigma (mean moving range / 1.128) and z. A missing value has its place in the series, and the range closes over it.

    Rows are numbered inside parts of the whole order, whose counts, ranges and last
    known values run over one row for each part, so no task holds a series.
    """
    d = in_order(df, [series], order)
    w = Window.partitionBy(series, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    near = d.select(series, "_part", "_at", F.col(value).alias("_v")).withColumn("_mr", F.abs(F.col("_v") - F.last("_v", ignorenulls=True).over(w)))
    known = F.col("_v").isNotNull()
    parts = near.groupBy(series, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_k"), F.sum("_v").alias("_s"), F.count("_mr").alias("_m"), F.sum("_mr").alias("_r"),
        F.min_by("_v", F.when(known, F.col("_at"))).alias("_head"), F.max_by("_v", F.when(known, F.col("_at"))).alias("_tail"),
    )
    every = Window.partitionBy(series)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_gap": F.abs(F.col("_head") - F.last("_tail", ignorenulls=True).over(earlier))})
    ranges, wide = F.sum("_m").over(every) + F.count("_gap").over(every), F.coalesce(F.sum("_r").over(every), F.lit(0.0)) + F.coalesce(F.sum("_gap").over(every), F.lit(0.0))
    limits = stored(parts.select(series, "_part", (F.col("_before") - F.col("_first") + 1).alias("_shift"), F.try_divide(F.sum("_s").over(every), F.sum("_k").over(every)).alias("centre"), (F.try_divide(wide, ranges) / 1.128).alias("sigma")))
    out = d.join(limits, [series, "_part"]).withColumn("i", (F.col("_at") + F.col("_shift")).cast("int"))
    return out.drop("_part", "_at", "_shift").withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("centre")) / F.col("sigma")))


def in_order(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """df, stored, with _at, which rises in the order of series and `order`, and _part: ranges of that order of bounded size, whatever a series holds. Inside a part _at has no gaps."""
    d = df.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order).withColumn("_at", F.monotonically_increasing_id())
    return stored(d).withColumn("_part", F.shiftright("_at", 33).cast("int"))  # part number and place in it


#: Rows of a series that a task of nelson() or ewma() holds at once.
BLOCK = 50_000


def nelson(df: DataFrame, series: str, z: str = "z", order: str = "i") -> DataFrame:
    """df with rule1 (beyond 3 sigma), rule2 (9 on one side), rule3 (6 rising or falling), rule5 (2 of 3 beyond 2 sigma on one side). order: 1, 2, ... in each series.

    A series falls into blocks, each with the 8 rows before it, so no task holds a series.
    """
    place = F.col(order) - 1
    own = F.floor(place / BLOCK)
    d = df.withColumn("_block", F.explode(F.when(F.pmod(place, F.lit(BLOCK)) >= BLOCK - 8, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(series, "_block").orderBy(order)
    v = F.coalesce(F.col(z), F.lit(0.0))
    nine, three = w.rowsBetween(-8, 0), w.rowsBetween(-2, 0)
    d = d.withColumn("_v", v).withColumn("_d", F.signum(v - F.lag(v).over(w)))
    five = w.rowsBetween(-4, 0)
    side = lambda c, over, n: (F.sum(F.when(c, 1).otherwise(0)).over(over) >= n)
    return d.withColumns({
        "rule1": F.abs("_v") > 3,
        "rule2": side(F.col("_v") > 0, nine, 9) | side(F.col("_v") < 0, nine, 9),
        "rule3": side(F.col("_d") > 0, five, 5) | side(F.col("_d") < 0, five, 5),
        "rule5": (side(F.col("_v") > 2, three, 2) | side(F.col("_v") < -2, three, 2)) & (F.col(order) >= 3),
    }).where(F.col("_block") == own).drop("_v", "_d", "_block")


def smoothed(x: np.ndarray, lam: float, run: int = 64) -> np.ndarray:
    """The exponentially weighted moving average from 0: runs of values at once, each from the end of the one before."""
    rows = -(-len(x) // run)
    padded = np.zeros(rows * run)
    padded[: len(x)] = x
    k = np.arange(run)
    own = padded.reshape(rows, run) @ np.triu(lam * (1 - lam) ** np.maximum(k[None, :] - k[:, None], 0))
    start = np.zeros(rows)
    for r in range(1, rows):
        start[r] = own[r - 1, -1] + (1 - lam) ** run * start[r - 1]
    return (own + start[:, None] * (1 - lam) ** (k + 1)).ravel()[: len(x)]


def ewma(df: DataFrame, series: str, value: str = "z", order: str = "i", lam: float = 0.2) -> DataFrame:
    """df with ewma from 0 on a standardised series, and its limit L = 3 with the time-varying variance. A missing value repeats the one before. order: 1, 2, ... in each series.

    A series falls into blocks that are averaged from 0 side by side; what a block starts
    from follows from one row for each block before it.
    """
    names, spark_schema = df.columns, df.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        v = table.column(value).cast(pa.float64()).to_numpy()
        known = ~np.isnan(v)
        count = np.cumsum(known)
        own = np.concatenate([[0.0], smoothed(v[known], lam)])[count]
        return pa.table({**{c: table.column(c) for c in (*names, "_block")}, "_own": own, "_count": count})

    out = StructType([*spark_schema.fields]).add("_block", "long").add("_own", "double").add("_count", "long")
    d = df.withColumn("_block", F.floor((F.col(order) - 1) / BLOCK))
    d = stored(d.groupBy(series, "_block").applyInArrow(run, out))
    ends = d.groupBy(series, "_block").agg(F.max_by("_own", order).alias("own"), F.max("_count").alias("count"))
    earlier = Window.partitionBy(series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.aggregate(F.collect_list(F.struct("own", "count")).over(earlier), F.lit(0.0), lambda s, x: s * F.pow(F.lit(1 - lam), x["count"]) + x["own"]), F.lit(0.0))
    starts = stored(ends.select(series, "_block", past.alias("_start")))
    ewma = F.col("_own") + F.col("_start") * F.pow(F.lit(1 - lam), F.col("_count"))
    return d.join(starts, [series, "_block"]).select(*names, ewma.alias("ewma"), (3 * F.sqrt(lam / (2 - lam) * (1 - F.pow(F.lit(1 - lam), 2 * F.col(order))))).alias("limit"))


def tost(df: DataFrame, group: Column, value: str, margin: float) -> DataFrame:
    """diff, se, df, p, low, high, equivalent: Welch's two one-sided tests of two groups (group: true for the first)."""
    d = df.agg(*[f(F.when(g, F.col(value))).alias(f"{k}{i}") for i, g in ((1, group), (2, ~group)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    d = d.select((F.col("m1") - F.col("m2")).alias("diff"), F.sqrt(a + b).alias("se"), (F.pow(a + b, F.lit(2)) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"))
    p = S.column(lambda x, s, k: np.maximum(1 - S.t_cdf((x + margin) / s, k), S.t_cdf((x - margin) / s, k)), "diff", "se", "df")
    t = S.column(lambda k: S.t_quantile(np.full(len(k), 0.95), k), "df")
    return d.withColumns({"p": p, "_t": t}).select("diff", "se", "df", "p", (F.col("diff") - F.col("_t") * F.col("se")).alias("low"), (F.col("diff") + F.col("_t") * F.col("se")).alias("high"), (F.col("p") < 0.05).alias("equivalent"))


def icc(df: DataFrame, cluster: str, y: Column) -> DataFrame:
    """n, k, n0, icc by one-way analysis of variance, 0 at least."""
    per = df.groupBy(cluster).agg(F.count(y).alias("m"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    t = per.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("between"))
    n, k = F.col("n"), F.col("k")
    n0 = (n - F.col("m2") / n) / (k - 1)
    msb, msw = (F.col("between") - F.col("s") * F.col("s") / n) / (k - 1), (F.col("q") - F.col("between")) / (n - k)
    return t.select("n", "k", n0.alias("n0"), F.when((k < 2) | (n <= k), 0.0).otherwise(F.greatest(F.lit(0.0), (msb - msw) / (msb + (n0 - 1) * msw))).alias("icc"))


def auroc(df: DataFrame, y: str, score: str) -> DataFrame:
    """n, positives, auroc, average_precision: by counts per distinct score, ties at half; one class alone has none."""
    per = stored(df.groupBy(score).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("m")).withColumn("q", F.col("m") - F.col("p")))
    d = total_before(per, score, ["p", "q"])
    up_p, up_q = F.col("p_all") - F.col("p_before"), F.col("q_all") - F.col("q_before")  # of this score and above
    s = d.agg(F.max("p_all").alias("pos"), F.max("q_all").alias("neg"), F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2)).alias("u"), F.sum(F.col("p") * up_p / (up_p + up_q)).alias("ap"))
    some = (F.col("pos") > 0) & (F.col("neg") > 0)
    return s.select((F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("positives"), F.when(some, F.col("u") / (F.col("pos") * F.col("neg"))).alias("auroc"), F.when(some, F.col("ap") / F.col("pos")).alias("average_precision"))


def dealt(i: np.ndarray, n: int, key: int | np.ndarray) -> np.ndarray:
    """A permutation of 0 to n - 1 by a keyed network of four rounds, applied to the numbers i: any part of it can be computed anywhere; of several keys, arrays that broadcast."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    both = np.broadcast_arrays(i.astype(np.uint64), np.asarray(key).astype(np.uint64))
    now, keys = (a.ravel() for a in both)
    mask, out, todo = np.uint64((1 << half) - 1), np.empty(len(now), np.int64), np.arange(len(now))
    while len(todo):  # numbers beyond n walk on until they come back
        left, right = now >> np.uint64(half), now & mask
        for r in range(4):
            x = (right + (keys * np.uint64(4) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(29)) & mask)
        now = (left << np.uint64(half)) | right
        out[todo] = now
        beyond = now >= np.uint64(n)
        todo, now, keys = todo[beyond], now[beyond], keys[beyond]
    return out.reshape(both[0].shape)


def energy_tests(df: DataFrame, vector: str, label: str, permutations: int = 199, seed: int = 1, block: int = 1_000, wide: int = 16_000) -> DataFrame:
    """label, n, m, energy, p: for each label, the energy distance between its vectors and all others, and its permutation test.

    Every pair of different vectors is needed, so work grows with the square of these:
    up to 16 equal ones of a label are one, with all its rows, they fall into blocks of
    about `wide`, a pair of blocks meets under one key, so a vector is
    sent as often as there are blocks, and a task adds up the distances inside and around
    each label and each permutation's rows, `block` by `block` vectors. Rows
    are numbered in the order of their labels, and each number is permuted once. A
    label's test takes the first rows of each permutation, as many as the smaller side
    has, so that labels of about one size share a product: only the few rows that one
    has more than the other are added one by one. No task holds more than two
    blocks. p is (1 + permutations at least as far apart) / (1 + permutations). Rows
    without a vector or label are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).alias("g"), F.col(vector).alias("v")).where("g is not null and v is not null")
    placed = stored(rows.repartitionByRange("g", F.xxhash64("v")).sortWithinPartitions("g").select("g", "v", F.monotonically_increasing_id().alias("at")))  # part number and place in it
    kept = placed.select("g", "v", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    parts = {r.part: r.n for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, n = {}, 0
    for k in sorted(parts):
        start[k], n = n, n + parts[k]
    labels = [(r.g, r.n) for r in kept.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("g").collect()]  # of a declared list
    kind = rows.schema["g"].dataType.simpleString()
    if len(labels) < 2:
        return spark.createDataFrame([], f"label {kind}, n bigint, m bigint, energy double, p double")
    ends = np.cumsum([c for _, c in labels])
    sizes = np.unique([min(c, n - c) for _, c in labels])
    narrow, kinds, keys = np.min_scalar_type(len(sizes)), len(sizes) + 1, seed * 1_000_003 + np.arange(1, permutations + 1)

    def deal(batches):
        """Up to 16 equal vectors of one label as one row; level: for each of them and each permutation, the first size under which it is among the first rows."""
        for q in batches:
            i = q.column("i").to_numpy()
            if not len(i):
                continue
            g, x, at = np.searchsorted(ends, i, side="right"), q.column("v").flatten().to_numpy().reshape(len(i), -1), np.arange(len(i))
            new = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]).any(1))
            first = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % 16 == 0)
            level = np.concatenate([np.searchsorted(sizes, dealt(i[u : u + 400, None], n, keys), side="right").astype(narrow) for u in range(0, len(i), 400)])
            cuts = np.append(first, len(i)).astype(np.int32)
            held = [None, pa.py_buffer(cuts * (level.itemsize * permutations)), pa.py_buffer(level.tobytes())]
            yield pa.RecordBatch.from_arrays([q.column("v").take(pa.array(first)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(i)), pa.Array.from_buffers(pa.binary(), len(first), held)], ["v", "i", "level"])

    index = F.try_element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("part")) + F.col("place")
    d = kept.select("g", index.cast("bigint").alias("i"), "v", F.xxhash64("v").alias("h"))
    d = d.repartitionByRange(4 * max(16, -(-n // wide)), "g", "h", "i").sortWithinPartitions("g", "h").select("i", "v")
    d = stored(d.mapInArrow(deal, f"v {rows.schema['v'].dataType.simpleString()}, i array<bigint>, level binary"))
    different = d.count()
    blocks = max(min(-(-different // block), 16), -(-different // wide))
    spans = []  # first and last of the sizes that share a product: the pairs of rows to add one by one are a hundredth of the vectors' at most
    for t, s in enumerate(sizes.tolist() if permutations else []):
        if spans and s * (s - int(sizes[spans[-1][0]])) <= different * different / 100:
            spans[-1][1] = t
        else:
            spans.append([t, t])
    d = d.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumns({"r": F.least("b", "other").cast("int"), "c": F.greatest("b", "other").cast("int")}).drop("other")
    d = d.withColumn("pair", (F.expr("c * (c + 1) div 2") + F.col("r")).cast("int"))

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distances of all rows of a to all of b, by one product that adds their squares too."""
        a, b = a.astype(float), b.astype(float)
        square = np.column_stack([-2 * a, (a * a).sum(1), np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T
        return np.sqrt(np.maximum(square, 0, out=square), out=square)

    def run(table: pa.Table) -> pa.Table:
        r, c, b = table.column("r")[0].as_py(), table.column("c")[0].as_py(), table.column("b").to_numpy()
        lists = table.column("i").combine_chunks()
        i, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.intp)
        begin = np.cumsum(count) - count
        g, item = np.searchsorted(ends, i[begin], side="right"), np.repeat(np.arange(len(b)), count)
        one, two = (at[np.argsort(g[at], kind="stable")] for at in (np.flatnonzero(b == r), np.flatnonzero(b == c)))  # labels lie side by side
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(b), -1)
        level = np.frombuffer(b"".join(table.column("level").to_pylist()), narrow).reshape(len(i), -1).T if permutations else np.zeros((0, len(i)), narrow)

        def side(at):
            """Vectors, their number of rows, where these begin, whose each is, and their levels."""
            many = count[at]
            cuts, whose = np.append(0, np.cumsum(many)), np.repeat(np.arange(len(at)), many)
            return x[at], many.astype(float), cuts, whose, np.ascontiguousarray(level[:, begin[at][whose] + np.arange(cuts[-1]) - cuts[whose]])

        (left, much, cuts, whose, low), (right, many, starts, theirs, high) = side(one), side(two)
        hot = [np.add.reduceat((high <= first).astype(np.uint8), starts[:-1], axis=1) for first, _ in spans if len(two)]  # rows of a vector among the first
        own, sums, every = np.zeros(len(ends)), np.zeros(len(b)), 0.0
        inside, across = np.zeros((permutations, kinds)), np.arange(permutations)[:, None] * kinds
        for u in range(0, len(one) if len(two) else 0, block):
            rows, at = one[u : u + block], slice(u, u + block)
            near = [np.zeros((permutations, len(rows))) for _ in spans]  # each vector's distances to the first rows of each permutation
            for w in range(u if r == c else 0, len(two), block):
                columns, beside = two[w : w + block], slice(w, w + block)
                dist = apart(left[at], right[beside])
                if r == c and u == w:
                    dist = np.triu(dist, 1)
                by_row = dist @ many[beside]
                every += much[at] @ by_row
                sums[rows] += by_row
                sums[columns] += much[at] @ dist
                for k in np.intersect1d(g[rows], g[columns]):
                    these, those = slice(*np.searchsorted(g[rows], [k, k + 1])), slice(*np.searchsorted(g[columns], [k, k + 1]))
                    own[k] += much[at][these] @ (dist[these, those] @ many[beside][those])
                for q, z in zip(near, hot):
                    q += z[:, beside].astype(float) @ dist.T
            some = slice(cuts[u], cuts[u + len(rows)])
            for q, (first, last) in zip(near, spans):
                got = np.bincount((np.maximum(low[:, some], first) + across).ravel(), q[:, whose[some] - u].ravel(), permutations * kinds).reshape(permutations, kinds)
                inside[:, first : last + 1] += got[:, first : last + 1]
        for first, last in spans:
            for k in range(permutations if last > first else 0):
                at, more = np.flatnonzero(low[k] <= last), np.flatnonzero((high[k] > first) & (high[k] <= last))
                dist = apart(left[whose[at]], right[theirs[more]])
                if r == c:
                    dist *= whose[at][:, None] < theirs[more]
                inside[k] += np.bincount(np.maximum.outer(low[k, at], high[k, more]).ravel(), dist.ravel(), kinds)
            inside[:, first : last + 1] = inside[:, first : last + 1].cumsum(1)
        around = [np.bincount(level[k], sums[item], kinds)[:-1].cumsum() for k in range(permutations)]
        numbers = np.concatenate([np.zeros(len(ends), np.int32), np.repeat(np.arange(1, permutations + 1, dtype=np.int32), len(sizes))])
        names = np.concatenate([np.arange(len(ends)), np.tile(sizes, permutations)])
        return pa.table({"k": numbers, "t": names, "inside": np.concatenate([own, inside[:, :-1].ravel()]), "around": np.concatenate([np.bincount(g, sums * count, len(ends)), *around]), "every": np.full(len(names), every)})

    met = d.repartitionById(min(blocks * (blocks + 1) // 2, 4_000), F.col("pair")).groupBy("pair")  # a task for each, as a pair of blocks is much work on few bytes
    met = met.applyInArrow(run, "k int, t bigint, inside double, around double, every double")
    sums = stored(met.groupBy("k", "t").agg(*[F.sum(c).alias(c) for c in ("inside", "around", "every")]))  # t: of k = 0 the label, else the size

    def energy(a: Column) -> Column:
        z, between = n - a, F.col("around") - 2 * F.col("inside")
        return a * z / (a + z) * (2 * between / (a * z) - 2 * F.col("inside") / (a * a) - 2 * (F.col("every") - F.col("inside") - between) / (z * z))

    names = spark.createDataFrame([(g, v, float(c), min(c, n - c)) for g, (v, c) in enumerate(labels)], f"t bigint, label {kind}, a double, size bigint")
    scale = 2 * (F.col("around") - 2 * F.col("inside")) / n  # what the statistic takes its terms from, so that equal splits stay equal
    e = sums.where("k = 0").join(F.broadcast(names), "t").select("label", "a", "size", energy(F.col("a")).alias("energy"), scale.alias("scale"))
    free = sums.where("k > 0").select(F.col("t").alias("size"), energy(F.col("t").cast("double")).alias("other"))
    per = e.join(free, "size", "left").groupBy("label", "a", "energy").agg(F.count_if(F.col("other") >= F.col("energy") - F.col("scale") * 1e-12).alias("hits"))
    return per.select("label", F.col("a").cast("bigint").alias("n"), (n - F.col("a")).cast("bigint").alias("m"), "energy", ((1 + F.col("hits")) / (1.0 + permutations)).alias("p"))
