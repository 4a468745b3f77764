"""Monitoring and count models against numpy, planted structure and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.operators import counts, curation, monitoring


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(x.shape[1])))


def test_robust_moments_ignore_planted_outliers(spark):
    rng = np.random.default_rng(1)
    cov = np.array([[2.0, 0.8, 0], [0.8, 1.0, 0], [0, 0, 0.5]])
    x = rng.multivariate_normal([1, 2, 3], cov, 3000)
    x[:450] += [30, -30, 20]
    d = frame(spark, x).union(spark.createDataFrame([(None, 1.0, 2.0)], "c0 double, c1 double, c2 double"))
    mean, got = monitoring.robust_moments(d, ["c0", "c1", "c2"])
    assert mean == pytest.approx([1, 2, 3], abs=0.12) and got == pytest.approx(cov, abs=0.25)
    n, plain, c = monitoring.moments(frame(spark, x), ["c0", "c1", "c2"])
    assert n == 3000 and plain == pytest.approx(x.mean(axis=0)) and c == pytest.approx(np.cov(x.T))


def test_scores_by_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 2)) @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(800, 5))
    d = frame(spark, x)
    m = monitoring.fit_monitor(d, d.columns, robust=False)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert m.a == 2 and m.values == pytest.approx(values, abs=1e-8)
    t = z @ vectors[:, :2]
    got = sorted((r.c0, r.t2, r.spe, sum(r.contributions)) for r in m.scores(d).collect())
    want = sorted(zip(x[:, 0], (t**2 / values[:2]).sum(axis=1), ((z - t @ vectors[:, :2].T) ** 2).sum(axis=1), strict=True))
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6) and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert all(g[1] == pytest.approx(g[3]) for g in got)
    flagged = m.scores(d).agg(F.avg(F.col("t2_flag").cast("int")), F.avg(F.col("spe_flag").cast("int"))).first()
    assert 0 <= flagged[0] < 0.03 and 0 <= flagged[1] < 0.03
    assert monitoring.residual_limit(np.array([0.5]), 0.05) == pytest.approx(0.5 * float(S.chi2_quantile(0.95, 1)), rel=0.05)


def test_negative_binomial(spark):
    rng = np.random.default_rng(3)
    year = np.repeat(np.arange(40), 15)
    m = np.exp(1.0 + 0.05 * (year - 20)) * 10
    y = rng.negative_binomial(1 / 0.3, 1 / (1 + 0.3 * m))
    d = spark.createDataFrame([("s", int(a), int(b), 10.0) for a, b in zip(year, y, strict=True)] + [("few", 1, 2, 1.0)], "k string, year int, y int, e double")
    got = {(r.k, r.term): r for r in counts.count_models(d, "k", "y", {"year": F.col("year") - 20}, "e").collect()}
    assert got["s", "year"].estimate == pytest.approx(0.05, abs=0.01) and got["s", "intercept"].estimate == pytest.approx(1.0, abs=0.1) and got["s", "year"].alpha == pytest.approx(0.3, abs=0.08)
    assert got["s", "year"].low < 1.0513 < got["s", "year"].high and ("few", "not estimable") in got
    x = np.column_stack([np.ones(600), year - 20])
    b, _, alpha, log = counts.negative_binomial(x, y.astype(float), np.full(600, np.log(10.0)))
    near = [counts.negative_binomial(x, y.astype(float), np.full(600, np.log(10.0) + s))[3] for s in (0, 0.1)]
    assert near[0] == pytest.approx(log) and near[1] == pytest.approx(log, abs=1e-4)  # the intercept takes a shift up


def test_interrupted_series_finds_the_planted_change(spark):
    rows = [(t, int(round(100 * np.exp(0.01 * (t - 30)) * (1 if t <= 33 else 0.5 * np.exp(-0.02 * (t - 33)))))) for t in range(60)]
    d = spark.createDataFrame(rows, "t int, n int").withColumn("k", F.lit(1))
    got = {r.term: r.estimate for r in counts.count_models(d, "k", "n", counts.interrupted(F.col("t"), 31, 33)).collect()}
    assert got["time"] == pytest.approx(0.01, abs=0.002) and got["time_post"] == pytest.approx(-0.02, abs=0.003) and got["post"] == pytest.approx(np.log(0.5), abs=0.05)


def test_there_are_23_flags():
    assert len(curation.plausibility_flags()) == 23
