"""Exact quantiles, running totals and rank correlations against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.operators import measures as M

SHARES = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("shape", ["distinct", "ties", "one value", "heavy tail"])
def test_narrowed_quantiles(spark, shape):
    rng = np.random.default_rng(3)
    v = {"distinct": rng.normal(size=3000), "ties": rng.integers(0, 7, 3000).astype(float), "one value": np.full(500, 2.5), "heavy tail": np.exp(3 * rng.normal(size=3000))}[shape]
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 5, "v double")
    assert np.allclose(M.exact_quantiles(d, "v", SHARES, few=40), np.quantile(v, SHARES), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    d = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert M.exact_quantiles(d.where("g = 'a'"), "v", [0.5]) == [None]
    assert {r.g: (r.n, r.q) for r in M.quantiles(d, "g", "v", [0.5]).collect()} == {"a": (0, None), "b": (1, [1.0])}
    assert M.quantiles(d.where("false"), "g", "v", [0.5]).count() == 0


def test_quantiles_of_groups_with_one_hot_group(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=2000), 2)
    g = np.where(np.arange(2000) % 3 == 0, "hot", np.array([f"g{i % 9}" for i in range(2000)]))
    d = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v, strict=True)] + [(None, 1.0), (None, 4.0)], "g string, v double")
    got = {r.g: r.q for r in M.quantiles(d, "g", "v", SHARES).collect()}
    for k in set(g):
        assert np.allclose(got[k], np.quantile(v[g == k], SHARES), rtol=1e-12)
    assert np.allclose(got[None], np.quantile([1.0, 4.0], SHARES))


def test_totals_before(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(v), int(rng.integers(1, 9)), int(rng.integers(0, 3))) for k in "ab" for v in rng.permutation(300)[:200]]
    got = M.total_before(spark.createDataFrame(rows, "g string, v int, n int, p int"), "v", ["n", "p"], "g", parts=16).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.g]
        assert (r.n_before, r.p_before) == (sum(x[2] for x in mine if x[1] < r.v), sum(x[3] for x in mine if x[1] < r.v))
        assert (r.n_all, r.p_all) == (sum(x[2] for x in mine), sum(x[3] for x in mine))


def test_rank_correlation_of_constants_is_unknown(spark):
    d = spark.createDataFrame([("a", 1, i) for i in range(5)] + [("b", i, -i) for i in range(5)], "g string, a int, b int")
    got = {r.g: r.rho for r in M.spearman(d, "g", "a", "b").select("g", F.round("rho", 9).alias("rho")).collect()}
    assert got == {"a": None, "b": -1.0}
