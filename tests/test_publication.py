"""Releases: the order of suppression, every fault of a folder, kept results, and similar headers and tokens."""

import json

import pytest
from pyspark.sql import functions as F

from siglot.operators import parsing as P
from siglot.operators import publication as U
from siglot.sources import files


def test_the_chain_hides_in_order(spark):
    """Linked measures go while the count is known, then the count, then a second cell of its block."""
    rows = [("a", "x", 3, 9.0, 30.0), ("a", "y", 7, 1.23456789, 50.0), ("a", "z", 90, 2.0, 3.0), ("b", "x", 8, 4.0, 98.0), ("b", "y", 0, None, None)]
    d = spark.createDataFrame(rows, "block string, cell string, n int, mean double, pct double")
    got = {(r.block, r.cell): r for r in U.protect(d, U.Rules({"n": ["pct"]}, {"n": ["mean"]}, (["block"], "n"), ("n", ["pct"]))).collect()}
    assert got["a", "x"].n_status == "primary" and got["a", "x"].n is None and got["a", "x"].mean is None and got["a", "x"].pct is None
    assert got["a", "y"].n_status == "secondary" and got["a", "y"].n is None and got["a", "y"].pct is None and got["a", "y"].mean == 1.234568
    assert got["a", "z"].n == 90 and got["a", "z"].pct is None  # 3 % of 90 is a small count
    assert got["b", "x"].n == 8 and got["b", "x"].pct == 98.0 and got["b", "y"].n == 0


def test_scalars(spark):
    d = spark.createDataFrame([("3",), ("0",), ("5",), ("n/a",), (None,)], "v string")
    assert [r.s for r in d.select(U.safe_scalar(F.col("v")).alias("s")).collect()] == ["<5", "0", "5", "n/a", None]


@pytest.fixture
def release(spark, tmp_path):
    root = tmp_path / "synthetic"
    d = spark.createDataFrame([("2017", 3, 1.0), ("2018", 40, 2.0)], "year string, n_target int, rate double")
    U.write_release(spark, f"file://{root}", {"by_year": (d, U.Rules({"n_target": ["rate"]}))})
    return root


def faults(spark, root, **how):
    return {(r.rule, r.file.rpartition("/")[2][:5], r.detail) for r in U.verify_release(spark, f"file://{root}", ["person_id", "full_name"], ["NOMBRES Y APELLIDOS"], **how).collect()}


def test_a_clean_release_passes(spark, release):
    assert faults(spark, release) == set()
    text = "".join(p.read_text() for p in release.rglob("part-*.csv"))
    assert "<5" in text and "2017" in text


def test_every_fault_is_found(spark, release):
    (release / "tables" / "leak.csv").write_text("person_id,when\nP1,2017-03-04\n")
    (release / "tables" / "leak.json").write_text(json.dumps({"x": [{"full_name": "A", "at": "2017-03-04", "made_utc": "2017-03-04"}]}))
    (release / "notes.md").write_text("NOMBRES Y APELLIDOS de la persona\n")
    (release / "data.xlsx").write_bytes(b"PK")
    (release / "tables" / "bad.json").write_text("{not json")
    part = next(p for p in release.rglob("part-*.csv") if "<5" in p.read_text())
    part.write_text(part.read_text().replace("<5", "3"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    got = faults(spark, release)
    rules = {r for r, *_ in got}
    assert rules >= {"column", "day", "key", "pattern", "type", "unlisted", "json", "changed", "small_count"}
    assert ("column", "leak.", "person_id") in got and ("key", "leak.", "$.x[0].full_name") in got and ("day", "leak.", "$.x[0].at") in got and not any("made_utc" in d for *_, d in got)
    assert any(r == "small_count" and "n_target=3" in d for r, _, d in got)
    assert any(r == "size" for r, *_ in faults(spark, release, most=20))


def test_a_table_of_many_parts_is_one_fault(spark, release, monkeypatch):
    """A table added afterwards: its header and that it isn't listed count once, its rows one by one, and no part outgrows the limit."""
    monkeypatch.setattr(U, "MOST_ROWS", 50)
    d = spark.range(0, 400, 1, 2).select(F.col("id").alias("person_id"), F.lit("2017-03-04").alias("day"))
    d.write.option("maxRecordsPerFile", U.MOST_ROWS).csv(f"file://{release}/tables/late", header=True)
    got = {(r.rule, r.table): r.n for r in U.by_table(U.verify_release(spark, f"file://{release}", ["person_id"], [])).collect()}
    assert got == {("column", "tables/late"): 1, ("unlisted", "tables/late"): 1, ("day", "tables/late"): 400}
    U.write_release(spark, f"file://{release.parent}/large", {"t": (d, U.Rules({}))})
    assert len(list((release.parent / "large").rglob("part-*.csv"))) == 8


def test_missing_files_and_other_names(spark, release, tmp_path):
    next(release.rglob("part-*.csv")).unlink()
    assert any(r == "missing" for r, *_ in faults(spark, release))
    other = release.rename(tmp_path / "public")
    assert ("origin" in {r for r, *_ in faults(spark, other)})
    for p in (other / "manifest").iterdir():
        p.unlink()
    (other / "manifest").rmdir()
    assert "no_manifest" in {r for r, *_ in faults(spark, other)}
    assert {r for r, *_ in faults(spark, tmp_path / "nope")} == {"no_release"}


def test_kept_results(spark, sf, tmp_path):
    root, source, runs = f"file://{tmp_path}/kept", f"{sf}/part.parquet", []

    def make():
        runs.append(1)
        return spark.read.parquet(source).groupBy("p_brand").count()

    first = U.kept_results(spark, root, [source], {"a": 1}, {"t": make})["t"]
    again = U.kept_results(spark, root, [source], {"a": 1}, {"t": make})["t"]
    assert len(runs) == 1 and sorted(first.collect()) == sorted(again.collect())
    assert all("kept" in f for f in again.inputFiles()) and "part.parquet" not in again._jdf.queryExecution().toString()
    tables, warnings = U.rebuilt(spark, root, {"a": 1})
    assert not warnings and tables["t"].count() == first.count()
    assert U.rebuilt(spark, root, {"a": 2})[1]
    U.kept_results(spark, root, [source], {"a": 2}, {"t": make})
    assert len(runs) == 2
    with pytest.raises(FileNotFoundError):
        U.rebuilt(spark, f"file://{tmp_path}/none", {})


def test_similar_headers(spark):
    h = spark.createDataFrame([("f", 0, "Fecha de vacunacion"), ("f", 1, "Fecha de vacunaciom"), ("f", 2, "Fecha de notifcación"), ("f", 3, "prov"), ("f", 4, "Lote numero"), ("g", 0, "fecha vacunacion")], "file string, position int, header string")
    a = spark.createDataFrame([("vaccinated", "Fecha de vacunacion", 1, None), ("notified", "Fecha de notificación", 1, None), ("province", "provincia", 1, None), ("lot", "lote numero 1", 1, None), ("other_lot", "lote numero 2", 1, None)], "field string, alias string, occurrence int, pattern string")
    got = {(r.file, r.position): (r.field, r.how) for r in files.match_headers(h, a).collect()}
    assert got == {("f", 0): ("vaccinated", "exact"), ("f", 1): (None, "unmatched"), ("f", 2): ("notified", "fuzzy"), ("f", 3): (None, "unmatched"), ("f", 4): (None, "unmatched"), ("g", 0): ("vaccinated", "fuzzy")}


def test_similar_tokens(spark):
    t = spark.createDataFrame([("ECONOMIA",), ("La Habanna",), ("Nowhere at all",), ("alpha beta x",)], "token string")
    rules = spark.createDataFrame([(1, "ECO.*", "ECO")], "position int, pattern string, code string")
    anchors = spark.createDataFrame([("HAB", "La Habana"), ("A1", "Alpha beta y"), ("A2", "Alpha beta z")], "code string, anchor string")
    got = {r.token: (r.code, r.rule) for r in P.map_tokens(t, rules, anchors=anchors).collect()}
    assert got["ECONOMIA"] == ("ECO", "regex") and got["La Habanna"] == ("HAB", "fuzzy")
    assert got["Nowhere at all"][1] == "unmapped" and got["alpha beta x"][1] == "unmapped"  # two anchors are as like
