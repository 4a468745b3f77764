"""Operators on small fixtures with known answers."""

import hashlib
import hmac
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.operators import curation, disclosure, linkage, measures, parsing, signals
from siglot.plans import registry
from siglot.sources import files


def values(spark, f, cells):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", f(F.col("c")).alias("r")).orderBy("i")
    return [tuple(x.r) for x in d.collect()]


def test_numbers(spark):
    got = values(spark, parsing.number, ["1.234,5", "1,234.5", "7,2", "1.234.567", "", "abc", "12"])
    assert got == [(1234.5, "recovered"), (1234.5, "recovered"), (7.2, "recovered"), (1234567.0, "recovered"), (None, "missing"), (None, "invalid"), (12.0, "ok")]


def test_yes_no_keeps_blank_unknown(spark):
    assert values(spark, parsing.yes_no, ["S", "nn", " ", "?", "quizás"]) == [(True, "ok"), (False, "recovered"), (None, "missing"), (None, "missing"), (None, "invalid")]


def test_words_and_accents_of_cells(spark):
    cells = ["S", " S ", "Sí", "N ", "NO", "SS", "N N", None, "", "quizás", "1", "0", "SIN DATOS", "no consta", "Desconocido", "N/A", "X"]
    yes, no = (True, "ok"), (False, "ok")
    none = (None, "missing")
    assert values(spark, parsing.yes_no, cells) == [yes, yes, yes, no, no, (True, "recovered"), (False, "recovered"), none, none, (None, "invalid"), yes, no, none, none, none, none, yes]
    assert values(spark, parsing.sex, ["M", "m", "F ", "M,", "Femenino", "varón", None, "X", "S/D"]) == [("M", "ok"), ("M", "ok"), ("F", "ok"), ("M", "ok"), ("F", "ok"), ("M", "ok"), none, (None, "invalid"), none]
    numbers = ["12,5", "20 000", "1,234,567", "-", "abc", "1e3", "≤ 5", "nan", "inf"]
    assert values(spark, parsing.number, numbers) == [(12.5, "recovered"), (20000.0, "ok"), (1234567.0, "recovered"), none, (None, "invalid"), (1000.0, "ok"), (None, "invalid"), none, (None, "invalid")]
    d = spark.createDataFrame([("Camagüey Ñandú áéíóú",), ("  Heber- biotec ",), ("R.L.S",), ("а́",)], "c string").select(parsing.fold(F.col("c")).alias("f"), parsing.normalize(F.col("c")).alias("n"), parsing.compact(F.col("c")).alias("k"))
    assert [tuple(r) for r in d.collect()] == [("Camaguey Nandu aeiou", "CAMAGUEY NANDU AEIOU", "CAMAGUEYNANDUAEIOU"), ("  Heber- biotec ", "HEBER BIOTEC", "HEBERBIOTEC"), ("R.L.S", "R L S", "RLS"), ("a", "A", "A")]


def test_ages_in_every_spelling(spark):
    day = 12 / 365.25
    want = {
        "6M": 6, "18 m": 18, "6 M": 6, "6m": 6, "6 MESES": 6, "2A": 24, "2 a": 24, "2 AÑOS": 24, "1A6M": 18, "1 A 6 M": 18, "RN": 0, "R.N.": 0, "recién nacido": 0,
        "15 D": 15 * day, "2 S": 14 * day, "1,5A": 18, "1.5 A": 18,
    }
    got = values(spark, parsing.age_months, list(want))
    assert [s for _, s in got] == ["ok"] * len(want) and [v for v, _ in got] == pytest.approx(list(want.values()))
    assert values(spark, parsing.age_months, ["6", "abc", "6X", "M6", None, "S/D"]) == [(None, "invalid")] * 4 + [(None, "missing")] * 2


def test_dates(spark):
    got = values(spark, parsing.date, ["2019-03-02", "2/3/2019", "3/25/2019", "43526", "n", "31/02/2019", "2 mar 19"])
    assert [(str(v) if v else None, s) for v, s in got] == [("2019-03-02", "ok"), ("2019-03-02", "ok"), ("2019-03-25", "recovered"), ("2019-03-02", "recovered"), (None, "not_applicable"), (None, "invalid"), ("2019-03-02", "recovered")]  # month words are a repair


def test_date_repair(spark):
    rows = [("2029-05-01", "2019-05-20", 2019), ("2010-01-01", "2010-02-01", 2019), ("2019-05-01", "2015-06-01", 2019), ("2005-12-30", "2019-01-10", 2019), ("1990-07-01", "2019-05-01", 2019)]
    d = spark.createDataFrame(rows, "v string, n string, y int").select(*parsing.repair_dates(F.to_date("v"), F.to_date("n"), F.col("y")))
    got = [tuple(map(str, r)) for r in d.collect()]
    assert got == [
        ("2019-05-01", "2019-05-20", "imputed_year", "kept"), ("2010-01-01", "2010-02-01", "kept_consistent", "kept_consistent"), ("2019-05-01", "2019-06-01", "kept", "imputed_year"),
        ("2018-12-30", "2019-01-10", "imputed_year", "kept"), ("2018-07-01", "2019-05-01", "imputed_year", "kept"),
    ]


def test_ages_and_keys(spark):
    assert [v for v, _ in values(spark, parsing.age_months, ["6M", "1A6M", "RN", "7", None])] == [6.0, 18.0, 0.0, None, None]
    d = spark.createDataFrame([("812M",), ("m-0812",)], "c string").select(parsing.core_key(F.col("c")).alias("k")).collect()
    assert [r.k for r in d] == ["812:M", "812:M"]


def test_accents_of_whole_texts(spark, sf):
    import unicodedata

    from siglot.plans.registry import QUERIES

    d = spark.createDataFrame([(0, "ñandú\nÅsa ﬁ ½"), (1, "МОСКВА ΑΒΓ x\u0301"), (2, None), (3, "a\u0323\u0301 😀 漢")], "i int, c string")
    got = [r.p for r in d.select("i", parsing.strip_accents(F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == ["nandu\nAsa fi 1⁄2", "MOCKBA ABΓ x", None, "a 😀 漢"]
    cyrillic, greek = ("АВЕКМНОРСТХУаеорсухіІјЈ", "ABEKMHOPCTXYaeopcyxiIjJ"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοικνρτυχ", "ABEZHIKMNOPTYXoikvptux")
    alike = {a: b for x, y in (cyrillic, greek) for a, b in zip(x, y, strict=True)}
    want = {r.doc_id: "".join(y for x in r.text for y in unicodedata.normalize("NFKD", alike.get(x, x)) if not unicodedata.combining(y)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.plain for r in QUERIES["c2_strip_accents_whole"](spark, sf).collect()} == want


def test_hmac_matches_the_library(spark):
    got = spark.createDataFrame([("ANA PÉREZ",)], "m string").select(parsing.hmac_token(F.col("m"), b"key").alias("t")).first().t
    assert got == hmac.new(b"key", "ANA PÉREZ".encode(), hashlib.sha256).hexdigest()[:20]


def test_special_functions():
    assert S.chi2_quantile(np.array([0.975]), 2.0)[0] / 2 == pytest.approx(3.688879, abs=1e-6)
    assert S.chi2_quantile(np.array([0.025, 0.975]), np.array([20.0, 22.0])) / 2 == pytest.approx([4.795389, 18.390356], abs=1e-6)
    assert S.t_quantile(np.array([0.975]), 10.0)[0] == pytest.approx(2.228139, abs=1e-6)
    assert S.beta_cdf(np.array([0.5]), 2.0, 3.0)[0] == pytest.approx(0.6875, abs=1e-12)
    assert S.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert S.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(0.4857142857, abs=1e-9)


def test_two_by_two_measures(spark):
    d = spark.createDataFrame([(20, 80, 100, 900, 100 * 120 / 1100), (0, 50, 10, 500, 50 * 10 / 560)], "a bigint, b bigint, c bigint, d bigint, expected double")
    got = d.withColumns({**signals.ror(), **signals.prr(), **signals.information()}).orderBy(F.desc("a")).collect()
    assert got[0].ror == pytest.approx(2.25) and got[0].prr == pytest.approx(2.0)
    assert all(np.isfinite([got[1][k] for k in ("ror", "ror_low", "prr", "chi2", "ic")]))


def test_unknown_events_count_as_absent(spark):
    m = spark.createDataFrame([(i, "x", t) for i, t in enumerate([True, True, False, False, False])], "record_id int, design string, target boolean")
    e = spark.createDataFrame([(i, "e", p) for i, p in enumerate([True, None, True, False, False])], "record_id int, event string, present boolean")
    r = signals.two_by_two(m, e).first()
    assert (r.a, r.b, r.c, r.d) == (1, 1, 1, 2)


def test_fdr_keeps_unknown(spark):
    d = spark.createDataFrame([(0.01,), (0.04,), (None,), (0.03,)], "p double").withColumn("f", F.lit(1))
    got = {r.p: r.p_adjusted for r in signals.fdr(d, "p", ["f"]).collect()}
    assert got == pytest.approx({0.01: 0.03, 0.04: 0.04, None: None, 0.03: 0.04})


def test_fuzzy_join_uses_indel_ratio(spark):
    a = spark.createDataFrame([("5750M",), ("ZZZ",)], "x string")
    b = spark.createDataFrame([("575M",), ("123Q",)], "y string")
    assert [(r.a, r.b, round(r.ratio, 1)) for r in linkage.fuzzy_join(a, b, "x", "y").collect()] == [("5750M", "575M", 88.9)]


def test_segments_find_a_step():
    x = np.concatenate([np.zeros(50), np.full(50, 5.0)]) + np.sin(np.arange(100)) * 0.1
    assert measures.segment(x, 2 * np.log(100), 10) == [0, 50]


def test_trend_of_constant_growth(spark):
    d = spark.createDataFrame([(2000 + i, n, 1e5) for i, n in enumerate([100, 110, 121])], "y int, n bigint, e double")
    assert measures.poisson_trend(d, "y", "n", "e")["rate_ratio"] == pytest.approx(1.1, abs=1e-6)


def test_month_coverage_ignores_a_stray_month(spark):
    rows = [(2020, m) for m in range(1, 8) for _ in range(40)] + [(2020, 11)]
    got = curation.month_coverage(spark.createDataFrame(rows, "year int, month int"), "year", "month").where("observed").count()
    assert got == 7


def test_suppression_rules(spark):
    d = spark.createDataFrame([(1, 0, 0.0), (2, 1, 1.0), (3, 4, 4.0), (4, 5, 5.0)], "i int, n int, pct double")
    got = {r.i: (r.n, r.pct) for r in disclosure.suppress(d, {"n": ["pct"]}).collect()}
    assert got == {1: (0, 0.0), 2: (None, None), 3: (None, None), 4: (5, 5.0)}
    cells = [("a", r, c, n) for r, ns in {"A": [3, 40, 50], "B": [60, 30, 20]}.items() for c, n in zip("xyz", ns, strict=True)]
    out = disclosure.suppress_cross(spark.createDataFrame(cells, "t string, r string, c string, n int"), ["t"], "r", "c", "n").toPandas()
    hidden = out[out.status != "visible"]
    assert (hidden.groupby("row").size() != 1).all() and (hidden.groupby("col").size() != 1).all()


def test_headers_by_occurrence_and_pattern(spark):
    h = spark.createDataFrame([("f", 1, "ASMA"), ("f", 2, "ASMA"), ("f", 3, "FIEBRE 39"), ("f", 4, "??")], "file string, position int, header string")
    a = spark.createDataFrame([("personal", "ASMA", 1, None), ("family", "ASMA", 2, None), ("fever", None, None, "FIEBRE.*")], "field string, alias string, occurrence int, pattern string")
    assert {r.position: (r.field, r.how) for r in files.match_headers(h, a).collect()} == {1: ("personal", "exact"), 2: ("family", "exact"), 3: ("fever", "pattern"), 4: (None, "unmatched")}


def test_a_year_twice_is_an_error(spark):
    with pytest.raises(ValueError, match="2001"):
        files.annual_series(spark.createDataFrame([("2001",), ("2001",)], "year string"), "year")


def test_entry_points_without_text_operators(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fuzzy_join_against_all_pairs(spark):
    import random

    r = random.Random(3)
    names = ["".join(r.choices("abcde", k=r.randrange(5, 14))) for _ in range(80)]
    typed = []
    for x in names:
        y = list(x)
        for _ in range(r.randrange(3)):
            y[r.randrange(len(y))] = r.choice(["", "a", "ez"])
        typed.append("".join(y))

    def lcs(a, b):
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        return row[-1][-1]

    want = {}
    for a in {t for t in typed if t}:
        best = sorted(((200.0 * lcs(a, b) / (len(a) + len(b)), b) for b in set(names)), key=lambda x: (-x[0], x[1]))
        if best[0][0] >= 85 and best[0][0] - best[1][0] >= 3:
            want[a] = (best[0][1], round(best[0][0], 6))
    left, right = spark.createDataFrame([(t,) for t in typed] + [(None,)], "t string"), spark.createDataFrame([(n,) for n in names], "n string")
    assert {x.a: (x.b, round(x.ratio, 6)) for x in linkage.fuzzy_join(left, right, "t", "n").collect()} == want and len(want) > 30


def test_cascade_levels(spark):
    lots = spark.createDataFrame([("1", "812M", "812:M", True, 2001), ("2", "BRAND77", "77:ABDNR", True, 2001), ("3", "77BRAND", "77:ABDNR", False, 2001), ("4", "ZZ55", "55:ZZ", True, 2001), ("5", "ZZ55", "55:ZZ", True, 2001)], "lot_key string, exact string, core string, national boolean, year int")
    tokens = [(1, "812M"), (2, "M812"), (3, "BRANT77"), (4, "ZZ55"), (5, "QQQ"), (6, None), (7, "812M"), (7, "BRAND77"), (8, "812M"), (8, "M0812")]
    d = spark.createDataFrame(tokens, "record_id int, exact string").withColumn("core", parsing.core_key(F.col("exact"))).withColumn("report_year", F.lit(2002))
    got = {r.record_id: (r.lot_key, r.level) for r in linkage.cascade(d, lots).collect()}
    assert got == {1: ("1", "exact"), 2: ("1", "core"), 3: ("2", "fuzzy"), 4: (None, "ambiguous"), 5: (None, "no_match"), 6: (None, "no_match"), 7: (None, "multiple_lots"), 8: ("1", "exact")}


def test_flags_of_reports_are_counted_as_long_events_are(spark):
    rows = [(1, ["A", "B", "A"], True, None), (2, ["A"], True, False), (3, ["B"], None, False), (4, [], True, True), (5, None, True, True)]
    r = spark.createDataFrame(rows, "record_id int, vaccines array<string>, e1 boolean, e2 boolean")
    got = {(x.vaccine, x.event): (x.n, x.expected) for x in signals.product_event_counts_of(r, "vaccines", ["e1", "e2"]).collect()}
    adm, events = r.select("record_id", F.explode("vaccines").alias("vaccine")), r.unpivot(["record_id"], ["e1", "e2"], "event", "present")
    assert got == {(x.vaccine, x.event): (x.n, x.expected) for x in signals.product_event_counts(adm, events).collect()}
    assert got["A", "e1"] == (2, 2.0) and got["B", "e2"][0] == 0
    long = signals.with_events(r.drop("vaccines"), ["e1", "e2"])
    assert sorted(map(str, long.collect())) == sorted(map(str, events.collect()))


@pytest.mark.parametrize("name", ["p1_two_by_two", "p7_product_event_counts", "p13_cumulative_ic"])
def test_no_report_is_joined_with_its_own_events(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join (Inner|LeftOuter)", plan)) == 2  # lines with parts, orders with lines
