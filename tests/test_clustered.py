"""Clustered models against their definitions on small fixtures, and against planted structure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.operators import clustered as C
from siglot.operators import models as R


def lots_of_reports(spark, lots=60, sd=0.0, slope=0.0, seed=1, rows=(5, 60)):
    """Reports of lots of very different sizes; z is the lot's attribute, x the report's own."""
    r = np.random.default_rng(seed)
    out = []
    for lot in range(lots):
        z, u = r.normal(), r.normal() * sd
        for _ in range(r.integers(*rows)):
            x = int(r.integers(0, 3))
            out.append((lot, float(z), x, int(r.random() < 1 / (1 + math.exp(0.6 - 0.5 * x - slope * z - u)))))
    return spark.createDataFrame(out, "lot int, z double, x int, y int").repartition(4), np.array(out)


def gee_by_definition(data, steps=200):
    """Estimating equations with the correlation matrix of each cluster written out."""
    lots, x, y = data[:, 0], np.column_stack([np.ones(len(data)), data[:, 1], data[:, 2]]), data[:, 3]
    b, alpha, p = np.zeros(3), 0.0, 3
    for _ in range(steps):
        info, u, meat, pairs, squares, n_pairs = np.zeros((p, p)), np.zeros(p), np.zeros((p, p)), 0.0, 0.0, 0
        for lot in np.unique(lots):
            at = lots == lot
            xs, ys, n = x[at], y[at], at.sum()
            m = 1 / (1 + np.exp(-xs @ b))
            a = np.diag(np.sqrt(m * (1 - m)))
            v = np.linalg.inv(a @ ((1 - alpha) * np.eye(n) + alpha * np.ones((n, n))) @ a)
            dm = xs * (m * (1 - m))[:, None]
            own = dm.T @ v @ (ys - m)
            info, u, meat = info + dm.T @ v @ dm, u + own, meat + np.outer(own, own)
            e = (ys - m) / np.sqrt(m * (1 - m))
            pairs, squares, n_pairs = pairs + (e.sum() ** 2 - (e * e).sum()) / 2, squares + (e * e).sum(), n_pairs + n * (n - 1) / 2
        cov = np.linalg.inv(info) @ meat @ np.linalg.inv(info)
        step, new = np.linalg.solve(info, u), pairs / (squares / (len(y) - p)) / (n_pairs - p)
        if abs(step).max() < 1e-10 and abs(new - alpha) < 1e-10:
            return b, cov, alpha
        b, alpha = b + step, new


def test_exchangeable_by_definition(spark):
    d, data = lots_of_reports(spark, lots=40, sd=0.9, slope=0.3)
    b, cov, alpha, n = C.exchangeable(C.patterns(R.design(d, ["z", "x"], "y", cluster="lot")), 3)
    want, wcov, walpha = gee_by_definition(data)
    assert n == 40 and b == pytest.approx(want, abs=1e-6) and cov == pytest.approx(wcov, rel=1e-4) and alpha == pytest.approx(walpha, abs=1e-6)


def test_planted_correlation(spark):
    """Outcomes that are the lot's own coin with probability r, else one's own, are correlated by r squared."""
    r, rows = np.random.default_rng(5), []
    for lot in range(400):
        coin = r.random() < 0.4
        rows += [(lot, int(coin if r.random() < 0.5 else r.random() < 0.4)) for _ in range(r.integers(4, 12))]
    d = spark.createDataFrame(rows, "lot int, y int")
    b, _, alpha, _ = C.exchangeable(C.patterns(R.design(d, [], "y", cluster="lot")), 1)
    assert alpha == pytest.approx(0.25, abs=0.05) and b[0] == pytest.approx(math.log(0.4 / 0.6), abs=0.15)


def test_lots_of_one_report_have_no_correlation(spark):
    d, _ = lots_of_reports(spark, lots=400, rows=(1, 2))
    design = C.patterns(R.design(d, ["z", "x"], "y", cluster="lot"))
    b, cov, alpha, n = C.exchangeable(design, 3)
    plain, inverse, _ = R.glm(design, 3)
    assert alpha == 0 and b == pytest.approx(plain, abs=1e-6)
    small = n / (n - 1) * (n - 1) / (n - 3)  # the factor that the other sandwich has
    assert cov * small == pytest.approx(R.cluster_robust(design, plain, inverse), rel=1e-4)


def test_random_intercepts(spark):
    d, _ = lots_of_reports(spark, lots=150, sd=0.8, slope=0.4, seed=7, rows=(40, 80))
    m, s, sd, bounds = C.random_intercepts(C.patterns(R.design(d, ["z", "x"], "y", cluster="lot")), 3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:], strict=False)) and len(bounds) > 3
    assert sd == pytest.approx(0.8, abs=0.15) and m[1] == pytest.approx(0.4, abs=0.25) and m[2] == pytest.approx(0.5, abs=0.12)
    assert (np.diag(s) > 0).all()


def test_pruning_from_the_end(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a + b), i % 3, float(i % 3 == 1)) for i, (a, b) in enumerate(r.normal(size=(60, 2)))]
    d = spark.createDataFrame(rows, "a double, b double, z double, year int, second double")
    assert C.prune_collinear(d, ["a", "b"], ["z"]) == (["a"], ["b"])  # an exposure stays
    assert C.prune_collinear(d, ["second", "C(year)", "a"], ["b"]) == (["second", "a"], ["C(year)"])
    assert C.prune_collinear(d, ["a", "C(year)"], ["b"]) == (["a", "C(year)"], [])


def test_family(spark):
    d, _ = lots_of_reports(spark, lots=60, slope=0.9, seed=3)
    d = d.withColumns({"noise": F.sin(F.col("lot") * 12.9), "blank": F.cos(F.col("lot") * 7.7)})
    outcomes = {"y": F.col("y"), "rare": F.when((F.col("lot") == 3) & (F.col("y") == 1) & (F.col("x") == 2), 1).otherwise(0), "form": F.when(F.col("lot") < 40, F.col("y"))}
    out = C.model_family(d, outcomes, ["z", "noise", "blank"], ["x"], "lot", negative_controls=("blank",), adjust_set=("z", "noise"), crude=True).toPandas()
    rare = out[out.outcome == "rare"]
    assert rare.model.tolist() == ["skipped"] and rare.n_events.iloc[0] < 10
    y = out[out.outcome == "y"]
    assert sorted(y.model) == ["crude"] * 3 + ["mutually_adjusted"] * 2 + ["single"] * 3
    assert set(out[out.p_bh.notna()].model) == {"single"} and not out[out.p_bh.notna()].negative_control.any()
    family = out[(out.model == "single") & (out.negative_control == False)]  # noqa: E712
    p = family.p_value.to_numpy()
    want = [min(q * len(p) / (sum(p <= q)) for q in p if q >= v) for v in p]
    assert family.p_bh.to_numpy() == pytest.approx(want)
    z = y[(y.exposure == "z") & (y.model == "single")].iloc[0]
    assert z.or_per_sd > 1.8 and z.p_bh < 1e-4 and z.or_lo < z.or_per_sd < z.or_hi
    form = out[out.outcome == "form"]
    assert (form.n_lots == 40).all() and form.n.max() < y.n.max()
    agreed = C.agreement(spark.createDataFrame(out, C.FAMILY), spark.createDataFrame([("y", "z", 1.4), ("y", "z", 0.8), ("form", "z", 2.0), ("y", "noise", 3.0)], "outcome string, exposure string, or_per_sd double")).first()
    assert agreed.n_tests == 4 and agreed.n_compared >= 3 and agreed.n_agree >= 2


def test_frames(spark):
    reports = spark.createDataFrame([(i, i % 4 == 0) for i in range(12)], "record_id int, coadministered boolean")
    links = spark.createDataFrame([(i, f"L{i % 3}", "exact" if i < 8 else "core", None if i % 5 else False) for i in range(11)] + [(11, None, "none", None)], "record_id int, lot_key string, match_level string, temporal_ok boolean")
    lots = spark.createDataFrame([("L0", 1.0, 5.0), ("L1", 2.0, 5.0), ("L2", 6.0, 5.0), ("L9", 99.0, 7.0)], "lot_key string, a double, same double")
    d, z, notes = C.linked_frame(reports, links, lots, ["a", "same"])
    assert z == ["z_a"] and len(notes) == 1 and d.count() == 8
    per = {r.lot_key: r.z_a for r in d.select("lot_key", "z_a").distinct().collect()}
    assert per["L0"] == pytest.approx((1 - 3) / np.std([1, 2, 6], ddof=1))
    assert C.linked_frame(reports, links, lots, ["a"], drop_implausible=False)[0].count() == 11
    assert C.linked_frame(reports, links, lots, ["a"], levels=("exact",))[0].count() == 6
    assert C.linked_frame(reports, links, lots, ["a"], exclude=F.col("coadministered"))[0].count() == 6


def test_folds_keep_lots_whole(spark):
    d, data = lots_of_reports(spark, lots=50)
    f = C.balanced_folds(d, "lot", 5).toPandas()
    sizes = f.merge(d.groupBy("lot").count().toPandas(), on="lot").groupby("fold")["count"].sum()
    assert len(f) == 50 == f.lot.nunique() and sizes.max() - sizes.min() <= 60 and len(sizes) == 5
    assert C.balanced_folds(d, "lot", 5, packed=10).count() == 50


def test_incremental_value(spark):
    d, _ = lots_of_reports(spark, lots=60, slope=1.0, seed=11)
    lots = d.groupBy("lot").agg(F.first("z").alias("z")).withColumn("junk", F.sin(F.col("lot") * 5.1))
    told = C.incremental_value(d, "y", ["x"], lots, ["z", "junk"], "lot", permutations=39).first()
    assert told.delta > 0.05 and told.p == pytest.approx(1 / 40) and told.n_lots == 60
    null = C.incremental_value(d, "y", ["x"], lots.select("lot", "junk"), ["junk"], "lot", permutations=39).first()
    assert null.p > 0.05 and (round(null.p * 40)) == pytest.approx(null.p * 40)


def test_counted_reports_are_reports(spark):
    """A family, a frame and the folds over distinct rows with their number are those over the rows themselves."""
    rng = np.random.default_rng(8)
    rows = [(int(i % 30), "exact" if i % 5 else "none", None if i % 7 else i % 2 == 0, int(rng.random() < 0.4), int(rng.integers(0, 3))) for i in range(3000)]
    d = spark.createDataFrame(rows, "lot_key int, match_level string, temporal_ok boolean, y int, c int").withColumn("record_id", F.monotonically_increasing_id())
    lots = spark.createDataFrame([(k, float(rng.normal())) for k in range(30)], "lot_key int, a double")
    plain, z, _ = C.linked_frame(d.select("record_id", "y", "c"), d.select("record_id", "lot_key", "match_level", "temporal_ok"), lots, ["a"])
    counted, same, _ = C.linked_frame(C.counted(d.drop("record_id")), None, lots, ["a"])
    assert z == same and counted.agg(F.sum("w")).first()[0] == plain.count()
    fit = lambda d, **how: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in C.model_family(d, {"y": F.col("y")}, z, ["c"], "lot_key", correlation="independence", **how).collect()]
    assert fit(plain) == fit(counted, weight="w")
    folds = lambda d, **how: sorted(tuple(r) for r in C.balanced_folds(d, "lot_key", 3, **how).collect())
    assert folds(plain) == folds(counted, weight="w")
