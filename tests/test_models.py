"""Models against closed forms, recomputation with numpy, and planted structure."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siglot.operators import measures as M
from siglot.operators import models as R


def rows(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * x[:, 0] - 0.4 * x[:, 1])))).astype(int)
    data = [(float(a), float(b), int(k), i % 50) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(data, "a double, b double, y int, c int").repartition(5)


def newton(x, y, w=None):
    x, b = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x, x.T @ (y - m))
    return b, x, 1 / (1 + np.exp(-x @ b))


def test_logistic_and_clustered_errors(spark):
    x, y, d = rows(spark)
    b, cov, _ = R.glm(R.design(d, ["a", "b"], "y", cluster="c"), 3)
    want, xs, m = newton(x, y)
    bread = np.linalg.inv((xs * (m * (1 - m))[:, None]).T @ xs)
    assert b == pytest.approx(want, abs=1e-6) and cov == pytest.approx(bread, rel=1e-5)
    score = np.zeros((50, 3))
    np.add.at(score, np.arange(len(y)) % 50, xs * (y - m)[:, None])
    robust = bread @ (score.T @ score) @ bread * 50 / 49 * (len(y) - 1) / (len(y) - 3)
    assert R.cluster_robust(R.design(d, ["a", "b"], "y", cluster="c"), b, cov) == pytest.approx(robust, rel=1e-4)


def test_firth_of_a_two_by_two_table(spark):
    """Firth's estimate of a saturated table adds a half to each cell, also to an empty one."""
    cells = {(1, 1): 12, (1, 0): 30, (0, 1): 0, (0, 0): 25}
    d = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "x int, y int")
    b, _, _ = R.glm(R.design(d, ["x"], "y"), 2, "binomial", "firth", steps=100)
    h = {k: n + 0.5 for k, n in cells.items()}
    assert b[1] == pytest.approx(math.log(h[1, 1] * h[0, 0] / (h[1, 0] * h[0, 1])), abs=1e-4)


def test_poisson_with_offset(spark):
    d = spark.createDataFrame([(0, 10.0, 100.0), (0, 14.0, 120.0), (1, 30.0, 100.0), (1, 33.0, 110.0)], "x int, y double, e double").withColumn("o", F.log("e"))
    b, _, phi = R.glm(R.design(d, ["x"], "y", offset="o"), 2, "poisson")
    assert b == pytest.approx([math.log(24 / 220), math.log((63 / 210) / (24 / 220))], abs=1e-6) and 0 < phi < 1


def test_flic_and_calibration(spark):
    x, y, d = rows(spark)
    design = R.design(d, ["a", "b"], "y")
    b = R.flic(design, R.glm(design, 3, "binomial", "firth")[0])
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert p.sum() == pytest.approx(y.sum(), abs=1e-3)  # predictions add up to the events
    scored = d.withColumn("p", 1 / (1 + F.exp(-(F.lit(float(b[0])) + float(b[1]) * F.col("a") + float(b[2]) * F.col("b")))))
    ok = R.calibration(scored, "y", "p").first()
    assert ok.intercept == pytest.approx(0, abs=0.01) and ok.slope == pytest.approx(1, abs=0.02)
    off = R.calibration(scored.withColumn("p", 1 / (1 + F.exp(-2 * F.log(F.col("p") / (1 - F.col("p"))) - 1))), "y", "p").first()
    assert off.slope == pytest.approx(ok.slope / 2, abs=0.02) and off.intercept < -0.5


def test_areas_by_definition(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 500), rng.integers(0, 2, 500)
    got = M.auroc(spark.createDataFrame(list(zip(map(int, s), map(int, y), strict=True)), "s int, y int"), "y", "s").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap = sum((y[s == t].sum() / y.sum()) * (y[s >= t].sum() / (s >= t).sum()) for t in set(s.tolist()))
    assert (got.n, got.positives) == (500, int(y.sum())) and got.auroc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
    none = M.auroc(spark.createDataFrame([(1, 1), (2, 1)], "s int, y int"), "y", "s").first()
    assert none.auroc is None and none.positives == 2


def test_spearman_by_definition(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 400), rng.normal(size=400).round(1)
    d = spark.createDataFrame([("g", int(x), float(y)) for x, y in zip(a, b, strict=True)] + [("g", None, 1.0), ("h", 1, 2.0)], "g string, a int, b double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    got = {r.g: r.rho for r in M.spearman(d, "g", "a", "b").collect()}
    assert got["g"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])


def test_planted_classes_are_found(spark):
    rng = np.random.default_rng(5)
    prob, kind = np.array([[0.9, 0.8, 0.9, 0.1, 0.1], [0.1, 0.2, 0.1, 0.9, 0.8]]), (rng.random(3000) < 0.3).astype(int)
    x = (rng.random((3000, 5)) < prob[kind]).astype(int)
    items = ["i1", "i2", "i3", "i4", "i5"]
    d = spark.createDataFrame([(*map(int, r), int(k)) for r, k in zip(x, kind, strict=True)], ", ".join(f"{i} int" for i in items) + ", kind int")
    d = d.withColumn("i1", F.when(F.rand(1) > 0.02, F.col("i1")))  # some unknown answers
    d = d.persist()
    best = R.best_classes(R.class_counts(d.groupBy(*items).agg(F.count(F.lit(1)).alias("weight")), items, most=3, starts=5)).persist()
    got = {r.classes: r for r in best.collect()}
    assert [k for k, r in got.items() if r.chosen] == [2] and got[1].bic > got[2].bic < got[3].bic
    assert got[2].shares == pytest.approx([0.7, 0.3], abs=0.03) and np.array(got[2].probabilities) == pytest.approx(prob, abs=0.05)
    right = R.assign(d, items, best).agg(F.avg((F.col("class") == F.col("kind")).cast("int")).alias("p"), F.min("posterior").alias("least")).first()
    assert right.p > 0.95 and right.least >= 0.5
    ari = R.class_stability(d.groupBy(*items).agg(F.count(F.lit(1)).alias("weight")), items, best, draws=8).agg(F.min("ari").alias("least"), F.count("ari").alias("n")).first()
    assert ari.n == 8 and 0.9 < ari.least <= 1


def test_adjusted_rand_by_pairs():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    pairs = [(a[i] == a[j], b[i] == b[j]) for i in range(60) for j in range(i)]
    both, one, two, n = sum(x and y for x, y in pairs), sum(x for x, _ in pairs), sum(y for _, y in pairs), len(pairs)
    assert R.adjusted_rand(a, b, np.ones(60)) == pytest.approx((both - one * two / n) / ((one + two) / 2 - one * two / n))
    assert R.adjusted_rand(a, a, np.ones(60)) == 1


def test_collinear_columns_are_dropped(spark):
    d = spark.createDataFrame([(float(i), float(i * i % 7), float(2 * i + i * i % 7), 3.0) for i in range(50)], "a double, b double, s double, one double")
    assert R.independent_columns(d, ["a", "b", "s", "one"]) == ["a", "b"]


def test_bootstrap_limits(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(10, 1, 400)
    d = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)] + [("t", 0, 1.0), ("s", -1, None)], "g string, i int, v double")
    got = {r.g: (r.ppk_low, r.ppk_high) for r in R.bootstrap_capability(d, "g", "v", 4, 16, draws=1000).collect()}
    reps = []
    for _ in range(1000):
        x = rng.choice(v, len(v))
        reps.append(min(x.mean() - 4, 16 - x.mean()) / (3 * x.std(ddof=1)))
    assert got["s"] == pytest.approx(np.percentile(reps, [2.5, 97.5]), abs=0.06)


def test_shift_by_all_differences(spark):
    d = spark.createDataFrame([("b", 1.0, True), ("b", 4.0, True), ("b", 0.5, False), ("b", 2.0, False)], "k string, v double, s boolean")
    assert R.hodges_lehmann(d, ["k"], "v", F.col("s")).first().shift == pytest.approx(np.median([0.5, 3.5, -1.0, 2.0]))


def test_bootstrap_sums_are_those_of_single_draws_and_quick():
    draws, rng = 500, np.random.default_rng(3)
    g, v, h = [("a", "b", None)[k] for k in rng.integers(0, 3, 4_000)], rng.normal(10, 1, 4_000), rng.integers(-(2**63), 2**63, 4_000)
    batch = pa.RecordBatch.from_arrays([pa.array(g), pa.array(v), pa.array(h)], ["g", "v", "h"])
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    seeds = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def plain():
        x = h.view(np.uint64)[:, None] ^ seeds
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(cuts, ((x >> np.uint64(11)) * 2.0**-53).ravel(), side="right").reshape(x.shape)

    run = R.bootstrap_sums(draws)
    began = time.process_time()
    w = plain()
    between = time.process_time()
    got = list(run(iter([batch])))
    assert time.process_time() - between < 0.8 * (between - began)
    for out in got:
        at = np.array([x == out.column("g")[0].as_py() for x in g])
        assert out.column("n").to_pylist() == w[at].sum(axis=0).tolist()
        assert np.allclose(out.column("s"), v[at] @ w[at], rtol=1e-12) and np.allclose(out.column("q"), v[at] ** 2 @ w[at], rtol=1e-12)
    assert {out.column("g")[0].as_py() for out in got} == {"a", "b", None}
