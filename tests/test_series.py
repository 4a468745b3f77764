"""Control charts and best splits whose series spread over many parts and blocks, against plain loops."""

import numpy as np
import pytest

from siglot.operators import measures as M

GROUPS = "ab"


@pytest.fixture
def parted(spark, monkeypatch):
    """Small ranges and blocks, and series with unknown values, some of them longer in a row than a block."""
    monkeypatch.setattr(M, "BLOCK", 40)
    for k, v in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    rng = np.random.default_rng(11)
    rows = []
    for g, n in zip(GROUPS, (700, 333), strict=True):
        v = np.round(rng.normal(size=n).cumsum() / 3 + rng.normal(size=n), 3)
        hole = (rng.random(n) < 0.2) | ((np.arange(n) > 200) & (np.arange(n) < 320))
        rows += [(g, int(i), None if h else float(x)) for i, (x, h) in enumerate(zip(v, hole, strict=True))]
    yield spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, k int, v double"), rows
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_charts_over_parts(parted):
    d, rows = parted
    held = M.in_order(d, ["g"], ["k"])
    assert held.select("_part").distinct().count() > 8
    got = {(r.g, r.k): r for r in M.ewma(M.nelson(M.individuals(d, "g", ["k"], "v"), "g"), "g").collect()}
    assert len(got) == len(rows)
    for g in GROUPS:
        v = [x for a, _, x in rows if a == g]
        known = np.array([x for x in v if x is not None])
        centre, sigma = known.mean(), np.abs(np.diff(known)).mean() / 1.128
        z = [None if x is None else (x - centre) / sigma for x in v]
        flat = np.array([0.0 if x is None else x for x in z])
        step = np.concatenate([[0.0], np.sign(np.diff(flat))])
        e = 0.0
        for i, x in enumerate(z):
            e = e if x is None else 0.8 * e + 0.2 * x
            r = got[g, i]
            assert r.i == i + 1 and r.centre == pytest.approx(centre) and r.sigma == pytest.approx(sigma) and (r.z is None) == (x is None)
            assert r.ewma == pytest.approx(e, abs=1e-9)
            nine, five, three = flat[max(0, i - 8) : i + 1], step[max(0, i - 4) : i + 1], flat[max(0, i - 2) : i + 1]
            assert r.rule1 == (abs(flat[i]) > 3)
            assert r.rule2 == ((nine > 0).sum() >= 9 or (nine < 0).sum() >= 9)
            assert r.rule3 == ((five > 0).sum() >= 5 or (five < 0).sum() >= 5)
            assert r.rule5 == (((three > 2).sum() >= 2 or (three < -2).sum() >= 2) and i >= 2)


def test_best_split_over_parts(parted):
    d, rows = parted
    got = {r.g: (r.n_before, r.gain) for r in M.best_split(d.where("v is not null"), ["g"], ["k"], "v").collect()}
    for g in GROUPS:
        v = np.array([x for a, _, x in rows if a == g and x is not None])
        k = np.arange(1, len(v))
        s = v.cumsum()[:-1]
        gain = s * s / k + (v.sum() - s) ** 2 / (len(v) - k) - v.sum() ** 2 / len(v)
        assert got[g] == (int(k[gain.argmax()]), pytest.approx(gain.max(), abs=1e-3))


def test_no_series_in_one_task(parted):
    """No window or group of the plans is dealt by the series alone."""
    d, _ = parted
    for out in (M.individuals(d, "g", ["k"], "v"), M.ewma(M.individuals(d, "g", ["k"], "v"), "g"), M.nelson(M.individuals(d, "g", ["k"], "v"), "g")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Window" in line and "[g#" in line and "_block" not in line and "_part" not in line for line in plan.splitlines())
