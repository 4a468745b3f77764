"""Long tables and summaries: unknown values, empty tables, and the rules that the queries' data don't show."""

from pyspark.sql import functions as F

from siglot.operators import summaries as S


def test_age_bands_are_open_to_the_right(spark):
    ages = [-1.0, -0.01, 0.0, 1.99, 2.0, 5.99, 6.0, 11.0, 12.0, 24.0, 72.0, 180.0, 731.9, 732.0, 900.0, None]
    got = [r.b for r in spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a double").select("i", S.age_band_label(F.col("a")).alias("b")).orderBy("i").collect()]
    assert got == [None, "0-2m", "0-2m", "0-2m", "2-4m", "4-6m", "6-11m", "6-11m", "12-23m", "2-5y", "6-14y", "15-60y", "15-60y", "61y+", "61y+", None]


def test_history_leaves_out_what_no_form_asked(spark):
    d = spark.createDataFrame([(1, True, None, None), (2, None, False, None)], "record_id int, hist_personal_hist_asthma boolean, hist_family_asthma boolean, hist_family_x boolean")
    got = {tuple(r) for r in S.history(d, "record_id", d.columns[1:]).collect()}
    assert got == {(1, "hist_asthma", True, "personal"), (2, "hist_asthma", None, "personal"), (1, "asthma", None, "family"), (2, "asthma", False, "family")}
    none = S.history(d.where("record_id > 5"), "record_id", d.columns[1:])
    assert none.columns == ["record_id", "condition", "present", "type"] and none.count() == 0


def test_links_without_rows_have_no_rates(spark):
    schema = "record_id int, analytic_year int, lot_key string, match_level string, temporal_ok boolean, lot_status string"
    empty = S.link_summary(spark.createDataFrame([], schema)).first()
    assert empty.n_target_reports == 0 and empty.link_rate is None and empty.lot_inconsistent_share is None
    rows = [(1, 2017, "a", "exact", True, "valid"), (2, 2017, None, "no_match", None, None), (3, 2018, "a", "core", False, "before_release"), (4, 2018, None, "ambiguous", None, "expired")]
    one = S.link_summary(spark.createDataFrame(rows, schema)).first()
    assert (one.n_linked, one.n_distinct_lots_linked, one.temporal_implausible, one.n_lot_assessable, one.n_lot_inconsistent, one.n_linked_inconsistent) == (2, 1, 1, 3, 2, 1)
    by = {r.analytic_year: (r.n_reports, r.n_linked, r.n_assessable, r.n_inconsistent) for r in S.link_counts(spark.createDataFrame(rows, schema), "analytic_year").collect()}
    assert by == {2017: (2, 1, 1, 0), 2018: (2, 1, 2, 2)}


def test_robust_signals_need_every_comparator_design(spark):
    rows = [("p", "a", True), ("q", "a", True), ("z", "a", False), ("p", "b", True), ("q", "b", False), ("p", "c", True), ("p", "d", None), ("q", "d", True), ("z", "b", True)]
    d = spark.createDataFrame(rows, "design string, event string, on boolean")
    got = {r.event: (r.n_designs, r.robust, r.influence, r.expected, r.emerging) for r in S.signal_groups(d, "on", "p", "z", spark.createDataFrame([("a",), ("a",)], "event string")).collect()}
    assert got == {"a": (2, True, False, True, False), "b": (1, False, True, False, True), "c": (1, False, False, False, True)}


def test_hidden_fields_are_a_number(spark):
    d = spark.createDataFrame([("age", 2, False), ("full_name", 1, False), ("address", 1, False), ("birth_date", 3, True)], "field string, n_files int, in_all boolean")
    got = {tuple(r) for r in S.public_drift(d, ["full_name", "address", "birth_date"]).collect()}
    assert got == {("age", False, 2), (None, False, 2)}
