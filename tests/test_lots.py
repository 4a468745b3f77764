"""Lot sheets, scales, keyed identifiers, designs, intervals and contributions against known answers."""

import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.operators import lots as O
from siglot.operators import models as R
from siglot.operators import monitoring as M
from siglot.operators.pseudonyms import TEST_KEY, Pseudonyms

COLS = {"lot_id": 0, "a": 1, "b": 2, "c": 3}


def test_only_the_row_below_the_header_can_hold_limits(spark):
    rows = [
        ("two", 1, 1, [None, "≥ 80 %", "70 - 130", "3"]), ("two", 2, 1, ["7A", "81", "99", "3"]), ("two", 3, 1, [None, "≥ 80 %", "70 - 130", "3"]),
        ("one", 1, 1, ["", "≥ 80 %", "70", "3"]), ("named", 1, 1, ["12", "≥ 80 %", "70 - 130", "< 3"]), ("short", 1, 1, [None, "≥ 80 %"]), ("header", 0, 1, [None, "≥ 1", "≥ 2", "≥ 3"]),
    ]
    limits, data = O.split_spec_row(spark.createDataFrame(rows, "file string, row int, start int, cells array<string>"), COLS, ["a", "b", "c"])
    assert {(r.file, r.row) for r in limits.collect()} == {("two", 1)}
    assert {(r.file, r.row) for r in data.collect()} == {("two", 2), ("two", 3), ("one", 1), ("named", 1), ("short", 1)}


def test_stated_limits_come_before_documented_ones(spark):
    grid = spark.createDataFrame([("x", 1, 1, [None, "> 80", "70 - 130", None]), ("y", 1, 1, ["1", "80", "90", None])], "file string, row int, start int, cells array<string>")
    known = spark.createDataFrame([("a", "ge", 80.0, None, None), ("b", "range", 70.0, 120.0, None)], "attribute string, op string, low double, high double, unit string")
    limits, _ = O.split_spec_row(grid, COLS, ["a", "b", "c"])
    got = {(r.file, r.attribute): (r.op, r.low, r.high, r.source, r.drift) for r in O.sheet_specs(grid, limits, COLS, ["a", "b", "c"], known).collect()}
    assert got == {
        ("x", "a"): ("gt", 80.0, None, "sheet", False), ("x", "b"): ("range", 70.0, 130.0, "sheet", True),
        ("y", "a"): ("ge", 80.0, None, "documented", True), ("y", "b"): ("range", 70.0, 120.0, "documented", True),
    }


def test_lots_without_values(spark):
    d = spark.createDataFrame([("f", 2, ["nota", "1", "x", "CU"]), ("f", 3, ["5 B", "-", None, None]), ("f", 4, [None]), ("f", 5, ["6", "2017", "ausencia total", "CU;CU;x"])], "file string, row int, cells array<string>")
    got = {r.row: r for r in O.lots_table(d, {"lot_id": 0, "production_year": 1, "q": 2, "destinations": 3}, [], {"q": ["AUSENCIA"]}, lambda t: F.when(t == "CU", "CU"), "CU").collect()}
    assert set(got) == {3, 5}
    assert (got[3].q_pass, got[3].destination_codes, got[3].national, got[3].n_destinations) == (None, None, False, 0)
    assert (got[5].production_year, got[5].q_pass, got[5].destination_codes, got[5].national) == (2017, True, ["CU", "OTHER"], True)


def test_scales_without_lots(spark):
    specs = spark.createDataFrame([("a", "ge", 10.0, None), ("b", "le", None, 1.0), ("c", "range", 5.0, 5.0)], "attribute string, op string, low double, high double")
    lots = spark.createDataFrame([], "a double, b double, c double")
    got = {r.attribute: (r.low, r.high, r.window_low, r.window_high, r.one_sided) for r in O.attribute_scales(specs, lots, ["a", "b", "c"], {"a": "log10"}, {"b": (-3.0, None)}).collect()}
    assert got == {"a": (1.0, None, 1.0, 2.0, "lower"), "b": (None, 1.0, -3.0, 1.0, "upper"), "c": (5.0, 5.0, 5.0, 6.0, None)}


def test_keyed_ids(spark):
    with pytest.raises(ValueError):
        Pseudonyms(b"short")
    with pytest.raises(ValueError):
        Pseudonyms(TEST_KEY)
    p = Pseudonyms(b"k" * 70)
    d = spark.createDataFrame([(1, "José  Pérez", "1990-02-03", "M"), (2, "JOSE PEREZ", "1990-02-03", "M"), (3, "José Pérez", None, "M"), (4, "José Pérez", None, "M"), (5, " ", "1990-02-03", None)], "row int, name string, birth string, sex string")
    person, strength = p.person(F.col("name"), F.col("birth").cast("date"), F.col("sex"), F.lit("ab"), F.col("row"))
    got = {r.row: (r.id, r.s) for r in d.select("row", person.alias("id"), strength.alias("s")).collect()}
    want = "P" + hmac.new(b"k" * 70, "person\x1fJOSE PEREZ\x1f1990 02 03\x1fM".encode(), hashlib.sha256).hexdigest()[:20]
    assert got[1] == got[2] == (want, "strong")
    assert len({got[k][0] for k in (3, 4, 5)}) == 3 and all(got[k][1] == "weak" and got[k][0][0] == "W" for k in (3, 4, 5))
    empty = d.where("row = 3").select(p.row_digest(F.col("name"), F.col("birth"), F.col("row")).alias("d")).first().d
    assert empty == hmac.new(b"k" * 70, "José Pérez\x1f\x1f3".encode(), hashlib.sha256).hexdigest()[:24]


def test_shift_and_its_interval(spark):
    rng = np.random.default_rng(3)
    rows = [("g", float(v), True) for v in rng.integers(0, 20, 30)] + [("g", float(v), False) for v in rng.integers(5, 25, 25)] + [("h", 4.0, True), ("h", 1.0, False), ("h", float("nan"), True), ("h", None, False), ("i", 2.0, True)]
    got = {r.k: r for r in R.hodges_lehmann(spark.createDataFrame(rows, "k string, v double, s boolean"), ["k"], "v", F.col("s")).collect()}
    x, y = (np.array([v for k, v, s in rows if k == "g" and s is w]) for w in (True, False))
    d = np.sort(np.subtract.outer(x, y).ravel())
    k = max(0, math.floor(len(d) / 2 - 1.959963984540054 * math.sqrt(len(d) * (len(x) + len(y) + 1) / 12)))
    assert (got["g"].shift, got["g"].low, got["g"].high) == (np.median(d), d[k], d[len(d) - 1 - k])
    assert (got["h"].n_x, got["h"].n_y, got["h"].shift, got["h"].low, got["h"].high) == (1, 1, 3.0, 3.0, 3.0) and "i" not in got


def test_design_and_its_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(1, 60)) if i % 4 else None, bool(rng.random() < 0.3 + 0.3 * (i % 2)) if i % 50 else None, bool(i % 2), i == 7, i % 3) for i in range(800)]
    d = spark.createDataFrame(rows, "id int, age double, y0 boolean, ev_a boolean, ev_rare boolean, n int")
    out, kept = R.report_design(d, "y0", "age", {"same": F.col("ev_a"), "none": F.lit(None).cast("boolean")}, ["ev_a", "ev_rare"], ["n"])
    assert kept == ["age_log", "age_missing", "same", "x_ev_a", "x_n"] and out.count() == 784
    ages = [r[1] for r in rows if r[1] is not None and r[2] is not None]
    assert [r.age_log for r in out.where("age is null").select("age_log").distinct().collect()] == [pytest.approx(np.median(np.log1p(ages)))]
    table, dropped = R.logistic_table(out, [c for c in kept if c != "x_n"])
    rows = {r.term: r for r in table.collect()}
    assert dropped == ["x_ev_a"] and set(rows) == {"age_log", "age_missing", "same"}
    assert rows["age_log"].n_with_term is None and rows["same"].n_with_term == sum(r[3] for r in d.where("y0 is not null").collect()) and rows["same"].ratio > 2


def test_top_contributors_of_flagged_lots(spark):
    rows = [(True, False, [3.0, -9.0, 1.0, 1.0]), (False, True, [0.0, 0.0, 0.0, -5.0]), (False, False, [9.0, 9.0, 9.0, 9.0]), (None, None, None)]
    d = spark.createDataFrame(rows, "t2_flag boolean, spe_flag boolean, contributions array<double>")
    got = {r.attribute: (r.n_flagged, r.n) for r in M.top_contributors(d, list("abcd"), 2).collect()}
    assert got == {"a": (2, 2), "b": (2, 1), "c": (2, 0), "d": (2, 1)}
