"""Tree attributions, energy tests, the prior, and versioned deliveries, against their definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.operators import attributions as A
from siglot.operators import parsing as P
from siglot.operators import measures as M
from siglot.operators import signals as G
from siglot.sources.files import scratch
from siglot.streaming import deliveries
from siglot.streaming.deliveries import VersionedTable, ingest_versions

#: Feature 0 twice on one path, three features in all, depth 3.
TREE = {
    "feature": np.array([0, 1, 0, -1, 2, -1, -1, -1, -1]),
    "threshold": np.array([0.5, 0.2, 0.8, np.nan, 0.4, np.nan, np.nan, np.nan, np.nan]),
    "left": np.array([1, 3, 5, -1, 7, -1, -1, -1, -1]),
    "right": np.array([2, 4, 6, -1, 8, -1, -1, -1, -1]),
    "value": np.array([0, 0, 0, 1.0, 0, -2.0, 4.0, 3.0, 0.5]),
    "cover": np.array([100.0, 60, 40, 25, 35, 30, 10, 15, 20]),
}


def known_value(tree, x, known, node=0):
    """The mean prediction where only the features in `known` are known: unknown splits go both ways by cover."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        return known_value(tree, x, known, left if x[f] <= tree["threshold"][node] else right)
    return sum(tree["cover"][c] * known_value(tree, x, known, c) for c in (left, right)) / tree["cover"][node]


def by_subsets(tree, x):
    n, out = len(x), np.zeros(len(x))
    for f in range(n):
        for size in range(n):
            for s in itertools.combinations([g for g in range(n) if g != f], size):
                share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[f] += share * (known_value(tree, x, {*s, f}) - known_value(tree, x, set(s)))
    return out


def test_attributions_by_subsets():
    x = np.random.default_rng(1).random((40, 3))
    got, base = A.shapley([TREE], x)
    assert base == pytest.approx(known_value(TREE, x[0], set()))
    for row, a in zip(x, got, strict=True):
        assert a == pytest.approx(by_subsets(TREE, row), abs=1e-12)
        assert a.sum() + base == pytest.approx(known_value(TREE, row, {0, 1, 2}))


def test_attributions_add_up_to_the_model(spark):
    r = np.random.default_rng(4)
    x = r.random((1500, 3))
    y = (r.random(1500) < 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 1] * x[:, 2])))).astype(int)
    d = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b, c), k in zip(x, y, strict=True)], "a double, b double, c double, y int")
    names = ["a", "b", "c"]
    model = A.fit_trees(d, names, "y", rounds=5, depth=3)
    got = A.attributed(d, A.trees_of(model), names)
    scored = model.transform(A.packed(d, names))
    from pyspark.ml.functions import vector_to_array

    want = {(q.a, q.b): q.p for q in scored.select("a", "b", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()}
    rows = got.collect()
    assert len(rows) == 1500
    for q in rows:
        assert 1 / (1 + math.exp(-q.margin)) == pytest.approx(want[q.a, q.b], abs=1e-9)
    means = {q.feature: q.mean_abs for q in A.importance(got, names).collect()}
    assert max(means, key=means.get) == "a" and means["a"] == pytest.approx(np.mean([abs(q.attributions[0]) for q in rows]))
    bins = A.dependence(got, names, top=1).orderBy("bin").collect()
    assert len(bins) == 10 and sum(q.n for q in bins) == 1500 and bins[0].mean < 0 < bins[-1].mean


def energy(v, one):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    n, m = one.sum(), (~one).sum()
    return n * m / (n + m) * (2 * d[np.ix_(one, ~one)].mean() - d[np.ix_(one, one)].mean() - d[np.ix_(~one, ~one)].mean())


def test_energy_of_sixty_vectors(spark):
    """All labels at once in blocks of seven, each permutation recomputed from the definition."""
    r = np.random.default_rng(2)
    v = np.vstack([r.normal(size=(25, 3)), r.normal(size=(20, 3)), r.normal(loc=1.2, size=(15, 3))])
    labels = ["a"] * 25 + ["b"] * 20 + ["c"] * 15
    order = r.permutation(60)
    d = spark.createDataFrame([([float(q) for q in v[i]], labels[i]) for i in order] + [(None, "a"), ([1.0, 2.0, 3.0], None)], "v array<double>, g string").repartition(3)
    got = {q.label: q for q in M.energy_tests(d, "v", "g", permutations=99, block=7).collect()}
    assert {k: (q.n, q.m) for k, q in got.items()} == {"a": (25, 35), "b": (20, 40), "c": (15, 45)}
    for k, q in got.items():
        assert q.energy == pytest.approx(energy(v, np.array([g == k for g in labels])), rel=1e-9)
        free = [energy(v, r.permutation(np.array([g == k for g in labels]))) for _ in range(600)]
        assert q.p == pytest.approx((1 + sum(f >= q.energy for f in free)) / 601, abs=0.12)
    assert got["c"].p == 0.01 and got["b"].p > 0.01


def test_permutations_are_permutations():
    for n in (1, 2, 7, 60, 1000):
        seen = [tuple(M.dealt(np.arange(n), n, k)) for k in range(20)]
        assert all(sorted(s) == list(range(n)) for s in seen)
    assert len(set(seen)) == 20
    means = np.mean([np.corrcoef(np.arange(1000), M.dealt(np.arange(1000), 1000, k))[0, 1] for k in range(200)])
    assert abs(means) < 0.01


def test_prior_by_likelihood(spark):
    r = np.random.default_rng(8)
    e = r.gamma(2.0, 4.0, 3000)
    lam = np.where(r.random(3000) < 0.25, r.gamma(1.5, 1 / 0.4, 3000), r.gamma(6.0, 1 / 7.0, 3000))
    n = r.poisson(lam * e)
    cells = spark.createDataFrame([(int(a), float(b)) for a, b in zip(n, e, strict=True)] + [(0, 0.0)], "n bigint, expected double")
    p = G.fit_prior(cells)

    def likelihood(a1, b1, a2, b2, w):
        parts = [sum(math.lgamma(a + k) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b / (b + x)) + k * math.log(x / (b + x)) for k, x in [(k, x)]) for a, b in ((a1, b1), (a2, b2)) for k, x in zip(n, e, strict=True)]
        one, two = np.array(parts[: len(n)]), np.array(parts[len(n) :])
        return float(np.logaddexp(math.log(w) + one, math.log1p(-w) + two).sum())

    assert p.converged and p.log_likelihood == pytest.approx(likelihood(*p[:5]), abs=1e-6)
    assert p.log_likelihood >= likelihood(1.5, 0.4, 6.0, 7.0, 0.25)  # the truth is no likelier
    for i in range(5):  # nor is any point beside it
        for f in (0.97, 1.03):
            q = list(p[:5])
            q[i] *= f
            assert likelihood(*q) < p.log_likelihood
    narrow, wide = sorted([(p.a1, p.b1, p.weight), (p.a2, p.b2, 1 - p.weight)], key=lambda c: c[0] / c[1])
    assert wide[2] == pytest.approx(0.25, abs=0.08) and narrow[0] / narrow[1] == pytest.approx(6 / 7, rel=0.1)


SCHEMA = "id int, period int, delivered int, v string"


def delivery(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_later_deliveries_supersede(spark):
    t = VersionedTable(spark, scratch(spark), delivery(spark, []).schema, ["id"], "period", "delivered")
    assert t.merge(delivery(spark, [(1, 1, 1, "a"), (2, 1, 1, "b"), (3, 2, 1, "c")]), 0) in ([1, 2], [2, 1])
    assert t.merge(delivery(spark, [(1, 1, 3, "A"), (5, 1, 3, "e")]), 1) == [1]  # lacks row 2
    now = {(r.id, r.period, r.v) for r in t.read().collect()}
    assert now == {(1, 1, "A"), (5, 1, "e"), (3, 2, "c")}
    t.merge(delivery(spark, [(2, 1, 2, "late")]), 2)  # an older file that comes late
    assert {(r.id, r.period, r.v) for r in t.read().collect()} == now
    assert {(r.id, r.v) for r in t.read(1).collect()} == {(1, "a"), (2, "b"), (3, "c")}  # what counted before


def test_a_batch_reads_the_periods_it_touches(spark):
    t = VersionedTable(spark, scratch(spark), delivery(spark, []).schema, ["id"], "period", "delivered")
    t.merge(delivery(spark, [(i, i % 3, 1, "x") for i in range(30)]), 0)
    files = t._rows(t._log(1), [1]).inputFiles()
    assert files and all(t._name(1) in f for f in files)
    t.merge(delivery(spark, [(100, 1, 2, "y")]), 1)
    again = t._rows(t._log(2)).inputFiles()
    assert sum("batch=1" in f for f in again) >= 1 and not any("batch=0" in f and t._name(1) in f for f in again)
    t.merge(delivery(spark, [(100, 1, 2, "y")]), 1)  # the batch runs again
    assert t.read().count() == 21


def test_added_rows_replace_by_key(spark):
    at = scratch(spark)
    for k, rows in enumerate([[(1, 1, 1, "a"), (2, 1, 1, "b")], [(2, 1, 2, "B"), (3, 1, 2, "c")], [(1, 1, 0, "old"), (4, None, 5, "no period")]]):
        delivery(spark, rows).coalesce(1).write.parquet(f"{at}/delivery={k}")
    out = ingest_versions(spark, at, delivery(spark, []).schema, ["id"], "period", "delivered", cumulative=False)
    assert {(r.id, r.v) for r in out.collect()} == {(1, "a"), (2, "B"), (3, "c")}


def test_counted_rows_are_rows(spark):
    """Importance and dependence of distinct rows with their number are those of the rows."""
    rows = [(float(i % 5), float(i % 3), [i % 5 - 2.0, 0.5 * (i % 3)]) for i in range(600)]
    d = spark.createDataFrame(rows, "a double, b double, attributions array<double>")
    few = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("w"))
    key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert few.count() < 20 and key(A.importance(few, ["a", "b"])) == key(A.importance(d, ["a", "b"]))
    assert key(A.dependence(few, ["a", "b"], rows=d)) == key(A.dependence(d, ["a", "b"]))


def test_energy_by_tiles(spark):
    """Blocks and tiles of any size give the same sums, also for single-precision vectors."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(int(i % 3), [float(v) for v in rng.normal(size=4) + (i % 3 == 0)]) for i in range(230)], "g int, v array<float>")
    key = lambda **how: [(r.label, r.n, round(r.energy, 8), r.p) for r in M.energy_tests(d, "v", "g", permutations=9, **how).orderBy("label").collect()]
    assert key() == key(block=20, wide=60) == key(block=7, wide=400)


def test_energy_permutations_of_uneven_labels(spark, monkeypatch):
    """Labels that share a product, that have one of their own and that hold most rows, and equal vectors: every p is that of its own permutations, whatever the blocks."""
    rng, tables, real = np.random.default_rng(6), [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: tables.append(real(df)) or tables[-1])
    for counts, kinds in (([5, 6, 6, 30, 31, 60, 79], None), ([9, 140], None), ([1, 1], None), ([2, 2], None), ([7, 8, 70, 80], 3)):
        v = rng.normal(size=(sum(counts), 3)) if kinds is None else rng.normal(size=(kinds, 3))[rng.integers(0, kinds, sum(counts))]
        d = spark.createDataFrame([(f"l{k}", [float(q) for q in x]) for x, k in zip(v, np.repeat(np.arange(len(counts)), counts))], "g string, v array<double>").repartition(3)
        for how in ({}, {"block": 20, "wide": 60}):
            tables.clear()
            got = {r.label: tuple(r)[1:] for r in M.energy_tests(d, "v", "g", permutations=39, **how).collect()}
            rows = tables[0].orderBy("at").collect()  # as they are numbered
            v, n, want = np.array([r.v for r in rows]), len(rows), {}
            for k, c in enumerate(counts):
                own = energy(v, np.array([r.g == f"l{k}" for r in rows]))
                free = [energy(v, M.dealt(np.arange(n), n, 1_000_003 + p) < min(c, n - c)) for p in range(1, 40)]
                want[f"l{k}"] = (c, n - c, pytest.approx(own, rel=1e-6 if kinds else 1e-9), pytest.approx((1 + sum(f >= own - 1e-9 for f in free)) / 40))
            assert got == want


def test_energy_permutes_each_row_once(spark, monkeypatch, tmp_path):
    """A row's numbers are permuted once, not again for each block that it meets."""
    path, real = str(tmp_path / "dealt"), M.dealt

    def counted(i, n, key):
        with open(path, "a") as f:
            f.write(f"{np.broadcast(i, key).size}\n")
        return real(i, n, key)

    monkeypatch.setattr(M, "dealt", counted)
    rng = np.random.default_rng(7)
    d = spark.createDataFrame([(i % 4, [float(v) for v in rng.normal(size=2)]) for i in range(90)], "g int, v array<double>")
    assert M.energy_tests(d, "v", "g", permutations=9, block=20).count() == 4
    with open(path) as f:
        assert sum(int(x) for x in f) == 90 * 9


def test_limits_are_parsed_once_for_each_text(spark):
    texts = ["no mayor de 20", "entre 70 y 130", "clear", None]
    d = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "k int, t string")
    got = sorted((r.k, r.s) for r in P.specs(d, "t", "s").collect())
    assert len(got) == 40 and got == sorted((r.k, r.s) for r in d.select("k", P.spec(F.col("t")).alias("s")).collect())


def test_a_large_period_spreads_over_files(spark, monkeypatch, tmp_path):
    """A period of more rows than a task takes is written by several, and a later delivery still replaces it."""
    monkeypatch.setattr(deliveries, "MOST_ROWS", 100)
    d = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("period"), F.lit(1).alias("delivered"), F.col("id").cast("double").alias("v"))
    table = VersionedTable(spark, f"file://{tmp_path}/t", d.schema, ["k"], "period", "delivered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be joined again
    table.merge(d.union(d), 0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.read().count() == 1000 and len(list((tmp_path / "t" / "rows" / "batch=0").rglob("part-*.parquet"))) > 1
    table.merge(d.where("k < 600").withColumn("delivered", F.lit(2)), 1)
    table.merge(d, 2)
    assert [tuple(r) for r in table.read().groupBy("delivered").count().collect()] == [(2, 600)]
