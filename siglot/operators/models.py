"""Models fitted by aggregations: generalised linear models with plain, penalised and cluster-robust inference, latent classes, boosted trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.sources.files import stored

Z = 1.959963984540054


def design(df: DataFrame, features: list[str], y: str, weight: str | None = None, offset: str | None = None, cluster: str | None = None) -> DataFrame:
    """x array<double> (with a leading 1), y, w, o and cluster; rows with an unknown value are left out."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    d = df.select(x.alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), (F.col(offset) if offset else F.lit(0.0)).cast("double").alias("o"), *([F.col(cluster).alias("cluster")] if cluster else []))
    return d.where("y is not null and not exists(x, v -> v is null)")


def _sums(d: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of f(x, y, w, o, n), a vector of `size`: one partial sum per task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                total += f(x, *(b.column(c).to_numpy() for c in "ywon"))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "v"])

    rows = d.select("x", "y", "w", "o", "n").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.i] = r.v
    return out


def _mean(family: str):
    if family == "binomial":
        return lambda e: 1 / (1 + np.exp(-np.clip(e, -30, 30))), lambda m: m * (1 - m)
    return lambda e: np.exp(np.clip(e, -30, 30)), lambda m: m


def glm(d: DataFrame, p: int, family: str = "binomial", penalty: str = "", steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, covariance, Pearson dispersion) of a design() by Newton's method: one aggregation per step, p numbers and a p x p matrix at the driver. penalty 'firth' adds the hat diagonal to the score, which bounds separated coefficients; the hat needs the information at the same coefficients, so a step takes two aggregations then."""
    mean, var = _mean(family)
    b, d = np.zeros(p), stored(d.groupBy("x", "y", "o").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n")))  # equal rows count as one, and steps don't run the design's plan again

    def parts(b, inverse=None):
        def run(x, y, w, o, n):
            m = mean(x @ b + o)
            v = w * var(m)
            r = w * (y - m)
            if inverse is not None:
                r = r + v * np.einsum("ij,jk,ik->i", x, inverse, x) * (0.5 - m)
            return np.concatenate([x.T @ r, ((x * v[:, None]).T @ x).ravel(), [(w * (y - m) ** 2 / var(m)).sum(), n.sum()]])

        return run

    for _ in range(steps):
        s = _sums(d, parts(b), p + p * p + 2)
        inverse = np.linalg.pinv(s[p : p + p * p].reshape(p, p))
        if penalty == "firth":
            s = _sums(d, parts(b, inverse), p + p * p + 2)
        step = inverse @ s[:p]
        step *= min(1.0, 5.0 / max(abs(step).max(), 1e-12))
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return b, inverse, s[-2] / max(1.0, s[-1] - p)


def cluster_robust(d: DataFrame, b: np.ndarray, inverse: np.ndarray, family: str = "binomial") -> np.ndarray:
    """The sandwich covariance over clusters, with the small-sample factor: scores are summed per cluster by Spark."""
    mean, _ = _mean(family)
    eta = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in b]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) + F.col("o")
    m = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
    r = F.col("w") * (F.col("y") - m)
    p = len(b)
    per = d.select("cluster", *[(F.get("x", F.lit(i)) * r).alias(f"s{i}") for i in range(p)]).groupBy("cluster").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)], F.count(F.lit(1)).alias("m"))
    t = per.agg(F.count(F.lit(1)), F.sum("m"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p)]).first()
    g, n = t[0], t[1]
    meat = np.array(t[2:], float).reshape(p, p)
    return inverse @ meat @ inverse * (g / max(1, g - 1)) * ((n - 1) / max(1, n - p))


def terms(names: list[str], b: np.ndarray, cov: np.ndarray) -> list[tuple]:
    """(term, odds or rate ratio, low, high, p)."""
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return [(k, math.exp(v), math.exp(v - Z * s), math.exp(v + Z * s), float(2 * S.normal_sf(abs(v) / s)) if s > 0 else None) for k, v, s in zip(["intercept", *names], b, se, strict=True)]


TERMS = "term string, ratio double, low double, high double, p double"


def _answers(pdf) -> tuple[np.ndarray, np.ndarray]:
    """Answers (unknown ones nan) and weights of distinct patterns, in one order."""
    x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float)
    order = np.lexsort(np.nan_to_num(x, nan=2.0).T)
    return x[order], pdf["w"].to_numpy()[order]


def _posterior(x: np.ndarray, share: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each pattern, its shares of the classes); unknown answers are integrated out."""
    seen = ~np.isnan(x)
    known = np.where(seen, x, 0.0)
    ll = np.log(share) + known @ np.log(prob).T + (seen - known) @ np.log1p(-prob).T
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    return top[:, 0] + np.log(like.sum(axis=1)), like / like.sum(axis=1, keepdims=True)


#: The conjugate prior of each answer's probability: Beta(1.5, 1.5), half an answer of either kind.
PRIOR = 1.5


def _mixture(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator, steps: int) -> tuple[float, int, np.ndarray, np.ndarray, bool]:
    """(log likelihood, steps, shares, probabilities, whether it settled) of a Bernoulli mixture from one random start, the largest class first. Probabilities are posterior modes, the likelihood is that of the answers alone."""
    seen = ~np.isnan(x)
    known = np.where(seen, x, 0.0)
    share, prob, before, settled = np.full(k, 1 / k), rng.uniform(0.2, 0.8, (k, x.shape[1])), -np.inf, False
    for step in range(1, steps + 1):
        each, r = _posterior(x, share, prob)
        log = float((w * each).sum())
        r = r * w[:, None]
        share = np.maximum(r.sum(axis=0) / w.sum(), 1e-10)
        share = share / share.sum()
        prob = np.clip((r.T @ known + PRIOR - 1) / (r.T @ seen + 2 * (PRIOR - 1)), 1e-12, 1 - 1e-12)
        if abs(log - before) < 1e-7 * max(1.0, abs(log)):
            settled = True
            break
        before = log
    order = np.argsort(-share)
    return float((w * _posterior(x, share, prob)[0]).sum()), step, share[order], prob[order], settled


def class_criteria(x: np.ndarray, w: np.ndarray, log: float, share: np.ndarray, prob: np.ndarray) -> dict[str, float]:
    """bic, aic, icl (BIC plus twice the entropy of the assignments), entropy_r2 (1: classes lie apart) and the smallest class's percentage."""
    k, q, n = len(share), x.shape[1], w.sum()
    p = np.clip(_posterior(x, share, prob)[1], 1e-300, 1)
    entropy, parameters = -float((w[:, None] * p * np.log(p)).sum()), k * q + k - 1
    bic = -2 * log + parameters * math.log(n)
    return {"bic": bic, "aic": -2 * log + 2 * parameters, "icl": bic + 2 * entropy, "entropy_r2": 1 - entropy / (n * math.log(k)) if k > 1 else 1.0, "smallest_pct": 100 * float(share.min())}


def adjusted_rand(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """The adjusted Rand index of two labellings of weighted points."""
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), w)
    two = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols, every = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), two(np.array([w.sum()]))
    expected, most = rows * cols / every, (rows + cols) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def class_stability(patterns: DataFrame, items: list[str], best: DataFrame, draws: int = 100, starts: int = 5, steps: int = 500, seed: int = 1) -> DataFrame:
    """draw, ari: agreement of the chosen classes with those refitted to a bootstrap sample of the rows, both assigned to all patterns. A draw is a task's work over the distinct patterns."""
    rows = patterns.select(F.array(*[F.col(c).cast("double") for c in items]).alias("x"), F.col("weight").cast("double").alias("w"))
    chosen = best.where("chosen").select("shares", "probabilities").first()
    share, prob = np.array(chosen.shares), np.array(chosen.probabilities)
    runs = patterns.sparkSession.range(draws).withColumnRenamed("id", "draw")
    met = rows.crossJoin(F.broadcast(runs)).repartition("draw")  # a declared number of draws

    def fit(key: tuple, pdf) -> object:
        import pandas as pd

        draw = int(key[0])
        x, w = _answers(pdf)
        rng = np.random.default_rng([seed, draw])
        sample = rng.multinomial(int(w.sum()), w / w.sum()).astype(float)
        some = sample > 0
        fits = [_mixture(x[some], sample[some], len(share), rng, steps) for _ in range(starts)]
        _, _, s, p, _ = max(fits, key=lambda f: f[0])
        return pd.DataFrame({"draw": [draw], "ari": [adjusted_rand(_posterior(x, share, prob)[1].argmax(axis=1), _posterior(x, s, p)[1].argmax(axis=1), w)]})

    return met.groupBy("draw").applyInPandas(fit, "draw bigint, ari double")


CRITERIA = ["bic", "aic", "icl", "entropy_r2", "smallest_pct"]


def class_counts(patterns: DataFrame, items: list[str], most: int = 7, starts: int = 20, steps: int = 500, seed: int = 1) -> DataFrame:
    """classes, start, log_likelihood, the criteria, converged, steps, shares, probabilities: Bernoulli mixtures of 1 to `most` classes from `starts` starts each, to convergence.

    Each fit is a task's work over the distinct response patterns with their weights,
    of which q yes/no/unknown items have at most 3^q, whatever the number of rows: meant for some ten items.
    """
    spark = patterns.sparkSession
    runs = spark.createDataFrame([(k, s) for k in range(1, most + 1) for s in range(starts if k > 1 else 1)], "classes int, start int")
    rows = patterns.select(F.array(*[F.col(c).cast("double") for c in items]).alias("x"), F.col("weight").cast("double").alias("w"))
    met = rows.crossJoin(F.broadcast(runs)).repartition("classes", "start")  # a declared list of runs

    def fit(key: tuple, pdf) -> object:
        import pandas as pd

        k, start = int(key[0]), int(key[1])
        x, w = _answers(pdf)
        log, steps_taken, share, prob, settled = _mixture(x, w, k, np.random.default_rng([seed, k, start]), steps)
        criteria = {c: [v] for c, v in class_criteria(x, w, log, share, prob).items()}
        return pd.DataFrame({"classes": [k], "start": [start], "log_likelihood": [log], **criteria, "converged": [settled], "steps": [steps_taken], "shares": [share.tolist()], "probabilities": [prob.tolist()]})

    return met.groupBy("classes", "start").applyInPandas(fit, f"classes int, start int, log_likelihood double, {', '.join(f'{c} double' for c in CRITERIA)}, converged boolean, steps int, shares array<double>, probabilities array<array<double>>")


def best_classes(fits: DataFrame) -> DataFrame:
    """Of class_counts() the best start for each number of classes, with chosen: the least BIC."""
    best = fits.groupBy("classes").agg(F.max_by(F.struct("log_likelihood", *CRITERIA, "converged", "shares", "probabilities"), F.struct("log_likelihood", -F.col("start"))).alias("b"))
    best = best.select("classes", "b.*")
    return best.withColumn("chosen", F.col("bic") == best.select(F.min("bic")).scalar())


def assign(df: DataFrame, items: list[str], best: DataFrame) -> DataFrame:
    """df with class (0: the largest) and its posterior share, by the chosen mixture, which is one row."""
    m = best.where("chosen").select("shares", "probabilities")
    x = F.array(*[F.col(c).cast("double") for c in items])
    log = lambda p: F.aggregate(F.zip_with(x, p, lambda v, pr: F.when(v.isNull(), 0.0).otherwise(v * F.log(pr) + (1 - v) * F.log(1 - pr))), F.lit(0.0), lambda s, v: s + v)
    d = df.withColumns({"_s": m.select("shares").scalar(), "_p": m.select("probabilities").scalar()})
    d = d.withColumn("_l", F.zip_with("_s", "_p", lambda s, p: F.log(s) + log(p)))
    top = F.array_max("_l")
    total = F.aggregate("_l", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("_l")))
    return d.withColumns({"class": (F.array_position("_l", top) - 1).cast("int"), "posterior": 1 / total}).drop("_s", "_p", "_l")


def calibration(df: DataFrame, y: str, p: str, tiny: float = 1e-6) -> DataFrame:
    """intercept (with the log odds as offset), slope: 0 and 1 where predictions are calibrated."""
    c = F.least(F.greatest(F.col(p), F.lit(tiny)), F.lit(1 - tiny))
    d = df.withColumn("_logit", F.log(c / (1 - c)))
    level = glm(design(d, [], y, offset="_logit"), 1)[0]
    slope = glm(design(d, ["_logit"], y), 2)[0]
    return df.sparkSession.createDataFrame([(float(level[0]), float(slope[1]))], "intercept double, slope double")


def flic(d: DataFrame, b: np.ndarray) -> np.ndarray:
    """Coefficients of a penalised fit with the intercept fitted anew by likelihood, so that predictions add up to the events."""
    eta = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in [0.0, *b[1:]]]), lambda x, v: x * v), F.lit(0.0), lambda s, v: s + v) + F.col("o")
    alone = d.select(F.array(F.lit(1.0)).alias("x"), "y", "w", eta.alias("o"))
    return np.concatenate([glm(alone, 1)[0], b[1:]])


def independent_columns(df: DataFrame, columns: list[str], tolerance: float = 1e-9) -> list[str]:
    """The columns that are no linear combination of a constant and those before them, from one aggregation of products."""
    every = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    k = len(every)
    got = df.agg(*[F.sum(every[i] * every[j]) for i in range(k) for j in range(k)]).first()
    gram = np.array(got, float).reshape(k, k)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram = gram / np.outer(scale, scale)
    kept = [0]
    for i in range(1, k):
        inner = gram[np.ix_(kept, kept)]
        rest = gram[i, i] - gram[i, kept] @ np.linalg.pinv(inner) @ gram[kept, i]
        if rest > tolerance:
            kept.append(i)
    return [columns[i - 1] for i in kept[1:]]


def boosted(train: DataFrame, test: DataFrame, features: list[str], y: str, rounds: int = 20) -> DataFrame:
    """test with score, by gradient-boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pack = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    model = GBTClassifier(featuresCol="_x", labelCol=y, maxIter=rounds, stepSize=0.1, maxDepth=4, minInstancesPerNode=30, subsamplingRate=0.8, seed=1).fit(pack.transform(train))
    out = model.transform(pack.transform(test))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def bootstrap_sums(draws: int) -> Callable:
    """A function of Arrow batches g, v, h that gives, for each group and replicate, the sums of weights, weighted values and weighted squares. A weight is a Poisson draw from the row's hash h and the replicate's number: the upper 16 bits of their mixture say it by a table, but where a cut of the distribution lies between, all bits do."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    seeds = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bins = np.arange(1 << 16) * 2.0**-16
    weight = np.searchsorted(cuts, bins, side="right").astype(np.int8)  # by the upper 16 bits of a hash
    weight[weight != np.searchsorted(cuts, bins + (2.0**-16 - 2.0**-53), side="right")] = -1  # a cut lies between: all bits decide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        x, y = (np.empty((16, draws), np.uint64) for _ in range(2))  # few rows at once, so that they stay in the cache
        for b in batches:
            names = b.column("g").dictionary_encode()
            kinds = [*names.dictionary.to_pylist(), None]
            of = names.indices.fill_null(len(kinds) - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            of, v, h = of[order], b.column("v").to_numpy()[order], b.column("h").to_numpy().view(np.uint64)[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(of)], strict=True):
                total = sums.setdefault(kinds[of[start]], np.zeros((3, draws)))
                for i in range(start, end, 16):
                    some = v[i : min(i + 16, end)]
                    u, t = x[: len(some)], y[: len(some)]
                    np.bitwise_xor(h[i : i + len(some), None], seeds, out=u)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        np.right_shift(u, np.uint64(shift), out=t)
                        np.bitwise_xor(u, t, out=u)
                        np.multiply(u, np.uint64(factor), out=u)
                    np.right_shift(u, np.uint64(48), out=t)
                    w = np.take(weight, t.view(np.int64), mode="wrap").ravel()
                    if len(close := np.flatnonzero(w < 0)):
                        w[close] = np.searchsorted(cuts, (u.ravel()[close] >> np.uint64(11)) * 2.0**-53, side="right")
                    total += np.stack([np.ones(len(some)), some, some * some]) @ w.reshape(u.shape).astype(float)
        for g, t in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws), pa.array(range(draws), pa.int32()), *map(pa.array, t)], ["g", "b", "n", "s", "q"])

    return run


def bootstrap_capability(df: DataFrame, group: str, value: str, low: float, high: float, draws: int = 2000) -> DataFrame:
    """group, ppk_low, ppk_high: each replicate weighs a row by a Poisson draw from a hash of the row and the replicate, so that it repeats exactly. Tasks add up weighted moments; one row for each group and replicate is shuffled."""
    kind = df.schema[group].dataType.simpleString()
    d = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))
    s = d.mapInArrow(bootstrap_sums(draws), f"g {kind}, b int, n double, s double, q double").groupBy("g", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 1")
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))
    ppk = s.select("g", F.when(sd > 0, F.least((mean - low) / (3 * sd), (high - mean) / (3 * sd))).alias("ppk"))
    return ppk.groupBy(F.col("g").alias(group)).agg(F.percentile("ppk", F.lit(0.025)).alias("ppk_low"), F.percentile("ppk", F.lit(0.975)).alias("ppk_high"))


def hodges_lehmann(df: DataFrame, block: list[str], value: str, side: Column, alpha: float = 0.05) -> DataFrame:
    """block, n_x, n_y, shift, low, high: the median of all differences between the two sides of each block, and the differences that the normal approximation of the rank-sum test counts in from either end.

    Equal values of a side, and equal differences, count once with their number; all
    others of a block are differences of its own two sides, so a block is a group of lots,
    not a corpus. Blocks with one side have no row.
    """
    d = df.select(*block, F.col(value).cast("double").alias("_v"), side.alias("_s")).where("_v is not null and not isnan(_v)")
    per = lambda s, v, n: d.where(s).groupBy(*block, F.col("_v").alias(v)).agg(F.count(F.lit(1)).alias(n))
    diffs = per("_s", "_x", "_m").join(per("not _s", "_y", "_k"), block).groupBy(*block, (F.col("_x") - F.col("_y")).alias("_d")).agg(F.sum(F.col("_m") * F.col("_k")).alias("_n"))
    upto = diffs.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*block).orderBy("_d")))
    sizes = d.groupBy(*block).agg(F.count_if("_s").alias("n_x"), F.count_if(~F.col("_s")).alias("n_y"))
    total = F.col("n_x") * F.col("n_y")
    inwards = F.floor(total / 2 - NormalDist().inv_cdf(1 - alpha / 2) * F.sqrt(total * (F.col("n_x") + F.col("n_y") + 1) / 12))
    placed = upto.join(sizes, block).withColumn("_k", F.greatest(F.lit(0), F.least(inwards, total - 1)))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_d")))  # noqa: E731  the i-th difference, from 0
    shift = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    return placed.groupBy(*block, "n_x", "n_y").agg(shift.alias("shift"), at(F.col("_k")).alias("low"), at(total - 1 - F.col("_k")).alias("high"))


def report_design(df: DataFrame, outcome: str, age: str, indicators: dict[str, Column], events: list[str], counts: list[str] = (), least_share: float = 0.002) -> tuple[DataFrame, list[str]]:
    """(df's rows with a known outcome, with y and all features; the names of those that can be estimated).

    Features: age_log, the logarithm of one plus the age, where unknown its median;
    age_missing; the indicators, the events and the counts, unknown ones 0. Events of
    fewer than least_share of the rows and features with one value are not named. The
    median is taken over distinct ages with their numbers, and one aggregation looks at
    all features.
    """
    d = df.where(F.col(outcome).isNotNull())
    log = F.log1p(F.col(age).cast("double"))
    ages = d.select(log.alias("a")).where("a is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    median = ages.agg(F.percentile("a", F.lit(0.5), F.col("n"))).first()[0] or 0.0
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    cols = {"age_log": F.coalesce(log, F.lit(median)), "age_missing": log.isNull().cast("int")} | {k: zero(c) for k, c in indicators.items()}
    cols |= {f"x_{c}": zero(F.col(c)) for c in [*events, *counts]}
    d = d.withColumns(cols | {"y": F.col(outcome).cast("int")})
    s = d.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))]).first()
    rare = {f"x_{c}" for c in events if (s[f"mean_x_{c}"] or 0) < least_share}
    return d, [c for c in cols if s[f"lo_{c}"] is not None and s[f"lo_{c}"] < s[f"hi_{c}"] and c not in rare]


def logistic_table(d: DataFrame, features: list[str], y: str = "y", least: float = 5) -> tuple[DataFrame, list[str]]:
    """(term, ratio, low, high, p, n_with_term of Firth's logistic regression; the features that are sums of others).

    Features that add up to less than `least` are too rare for a term. n_with_term is
    the number of rows with a feature of two values.
    """
    s = d.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))]).first()
    often = [c for c in features if (s[f"sum_{c}"] or 0) >= least]
    between = d.agg(*[F.count_if((F.col(c) != s[f"lo_{c}"]) & (F.col(c) != s[f"hi_{c}"])).alias(c) for c in often]).first() if often else {}
    kept = independent_columns(d, often)
    b, inverse, _ = glm(design(d, kept, y), len(kept) + 1, "binomial", "firth")
    rows = [(*t, int(s[f"sum_{t[0]}"]) if between[t[0]] == 0 else None) for t in terms(kept, b, inverse)[1:]]
    return d.sparkSession.createDataFrame(rows, TERMS + ", n_with_term bigint"), [c for c in often if c not in kept]
