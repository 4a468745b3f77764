"""Queries of long tables and of the summaries that a study reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import curation as C
from siglot.operators import linkage as L
from siglot.operators import signals as G
from siglot.operators import summaries as S
from siglot.plans import linking, signals, tables
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes, table
from siglot.sources import files

_COMP = ", ".join(f"'{x}'" for x in V.COMPARATORS)
_BANDS = " ".join(f"when m >= {lo} then '{name}'" for lo, name in sorted(S.AGE_BANDS.items(), reverse=True))


@query("d12_stays_and_ages", f"""
with t as (select l_orderkey, l_linenumber, l_partkey, cast(o_orderdate as date) as v, case when l_tax > 0.01 then cast(l_shipdate as date) end as n, case when l_returnflag <> 'N' then cast(o_orderdate as date) + 3 end as a,
  case when l_linestatus = 'F' then cast(l_shipdate as date) end as d, case when l_linenumber < 7 then (l_quantity - 1) * l_linenumber * 3 end as m from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, cast(n - v as integer) as notification_delay_days, cast(d - a as integer) as los_days, round(m / 12, 6) as age_years, m < 12 as infant, case {_BANDS} end as age_band from t
""")
def _d12(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    v, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    out = S.stays_and_ages(
        v, F.when(F.col("l_tax") > 0.01, s), F.when(F.col("l_returnflag") != "N", F.date_add(v, 3)), F.when(F.col("l_linestatus") == "F", s),
        F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") - 1) * F.col("l_linenumber") * 3),
    )
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 6) if k == "age_years" else c).alias(k) for k, c in out.items()])


_HISTORY = ["hist_personal_allergy", "hist_personal_surgery", "hist_family_allergy", "hist_family_unasked"]


@query("d18_history", """
with h as (select o_orderkey as record_id, case when o_orderstatus <> 'P' then c_mktsegment = 'MACHINERY' end as pa, c_acctbal < 0 as ps, case when o_orderpriority <> '5-LOW' then c_nationkey % 5 = 0 end as fa from orders join customer on o_custkey = c_custkey)
select record_id, 'allergy' as condition, pa as present, 'personal' as type from h union all select record_id, 'surgery', ps, 'personal' from h union all select record_id, 'allergy', fa, 'family' from h
""")
def _d18(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    flags = [F.when(F.col("o_orderstatus") != "P", F.col("c_mktsegment") == "MACHINERY"), F.col("c_acctbal") < 0, F.when(F.col("o_orderpriority") != "5-LOW", F.col("c_nationkey") % 5 == 0), F.lit(None).cast("boolean")]
    return S.history(d.select(F.col("o_orderkey").alias("record_id"), *[c.alias(k) for k, c in zip(_HISTORY, flags, strict=True)]), "record_id", _HISTORY)


_WINDOW = f"""{ctes('reports')}, w as (select *, list_contains(vaccines, '{V.TARGET}') as t, not list_contains(vaccines, '{V.TARGET}') and len(list_intersect(vaccines, [{_COMP}])) > 0 as comp, len(vaccines) > 1 as co,
  case when ev_open then null when ev_big then 'too_young' when ev_bulk then 'late' else 'on_schedule' end as status from reports where analytic_year between 1996 and 2000)"""


def _window(spark, sf):
    target = F.array_contains("vaccines", V.TARGET)
    comparator = ~target & F.arrays_overlap("vaccines", F.array(*[F.lit(x) for x in V.COMPARATORS]))
    status = F.when(F.col("ev_open"), None).when(F.col("ev_big"), "too_young").when(F.col("ev_bulk"), "late").otherwise("on_schedule")
    d = V.reports(spark, sf).where("analytic_year between 1996 and 2000")
    d = d.withColumns({"has_target": target, "comparator": comparator, "coadministered": F.size("vaccines") > 1, "schedule_status": status})
    return d.withColumn("schedule_invalid", F.col("schedule_status") == "too_young")


@query("d23_flow_of_the_window", _WINDOW + """, v as (select *, coalesce(status = 'too_young', false) as bad from w)
select count(*) as n_window, count(*) filter (t) as n_target, count(*) filter (t and bad) as n_target_schedule_invalid, count(*) filter (t and not bad) as n_target_analysed, count(*) filter (t and not bad and co) as n_target_coadministered,
  count(*) filter (comp) as n_comparator, count(*) filter (not t and not comp) as n_neither, count(*) filter ((t and not bad) or comp) as n_population from v
""")
def _d23(spark, sf):
    return S.population_flow(_window(spark, sf))


@query("d23_comparator_products", _WINDOW + f", u as (select unnest(list_intersect(vaccines, [{_COMP}])) as vaccine from w where comp) select vaccine, count(*) as n from u group by 1")
def _d23b(spark, sf):
    return S.comparator_product_counts(_window(spark, sf), V.COMPARATORS)


@query("d23_schedule_summary", _WINDOW + ", s as (select analytic_year, coalesce(status, 'unknown') as status from w where t) select analytic_year, status, count(*) as n from s group by grouping sets ((analytic_year, status), (status))")
def _d23c(spark, sf):
    return S.schedule_summary(_window(spark, sf))


@query("d23_window_summary", ctes("reports") + """, f as (select *, cast(1992 + record_id % 8 as integer) as file_year from reports)
select count(*) as n_reports_total, count(*) filter (analytic_year between 1996 and 2000) as n_in_window, count(*) filter (analytic_year not between 1996 and 2000) as n_outside_window, count(*) filter (analytic_year <> file_year) as n_year_differs_from_file, list_sort(list(distinct file_year)) as file_years from f
""")
def _d23d(spark, sf):
    return S.window_summary(V.reports(spark, sf).withColumn("file_year", (1992 + F.col("record_id") % 8).cast("int")), 1996, 2000)


_LINKS = linking._CHOICE + """, k as (select record_id, record_id % 4 as k from tokens),
j as (select record_id, case when n = 1 and k < 3 then lot end as lot_key, case when k = 3 or n is null then 'no_match' when n > 1 then 'ambiguous' when k = 0 then 'exact' when k = 1 then 'core' else 'fuzzy' end as match_level from k left join ch using (record_id)),
links as (select j.*, report_year as analytic_year, year <= report_year as temporal_ok, case when year is null then 'not_assessable' when report_year < year then 'before_release' when report_year > year + 3 then 'expired' else 'valid' end as lot_status
  from j join tokens using (record_id) left join (select distinct lot_key, year from lots) l using (lot_key)),
b as (select *, lot_status in ('expired', 'before_release') as bad, lot_status <> 'not_assessable' as ass from links)
"""


def _links(spark, sf):
    """Every token's link, with what the lot's year says about it."""
    from siglot.plans.registry import QUERIES

    found = QUERIES["j8_cascade"](spark, sf).withColumnRenamed("level", "match_level")
    lots = linking._lots(spark, sf).select("lot_key", "year").distinct()
    d = found.join(linking._tokens(spark, sf).select("record_id", F.col("report_year").alias("analytic_year")), "record_id").join(lots, "lot_key", "left")
    return d.withColumns({"temporal_ok": F.col("year") <= F.col("analytic_year"), "lot_status": L.lot_status(F.col("analytic_year"), F.col("year"), 3)})


@query("j12_link_summary", _LINKS + """select count(*) as n_target_reports, count(lot_key) as n_linked, count(distinct lot_key) as n_distinct_lots_linked, count(*) filter (not temporal_ok) as temporal_implausible, count(*) filter (ass) as n_lot_assessable,
  count(*) filter (bad) as n_lot_inconsistent, count(*) filter (lot_status = 'expired') as n_lot_expired, count(*) filter (lot_status = 'before_release') as n_lot_before_release, count(*) filter (bad and lot_key is not null) as n_linked_inconsistent,
  count(*) filter (match_level = 'exact') as n_exact, count(*) filter (match_level = 'core') as n_core, count(*) filter (match_level = 'fuzzy') as n_fuzzy, round(count(lot_key) / count(*), 6) as link_rate, round(count(*) filter (bad) / nullif(count(*) filter (ass), 0), 6) as lot_inconsistent_share from b""")
def _j12(spark, sf):
    return S.link_summary(_links(spark, sf)).withColumns({c: F.round(c, 6) for c in ("link_rate", "lot_inconsistent_share")})


@query("j12_links_by_year", _LINKS + "select analytic_year, count(*) as n_reports, count(lot_key) as n_linked, count(*) filter (ass) as n_assessable, count(*) filter (bad) as n_inconsistent from b group by 1")
def _j12b(spark, sf):
    return S.link_counts(_links(spark, sf), "analytic_year")


@query("j12_links_by_level", _LINKS + "select match_level, count(*) as n_reports, count(lot_key) as n_linked, count(*) filter (ass) as n_assessable, count(*) filter (bad) as n_inconsistent from b group by 1")
def _j12c(spark, sf):
    return S.link_counts(_links(spark, sf), "match_level")


_IC = "log2((a + 0.5) / (cast(a + b as double) * (a + c) / (a + b + c + d) + 0.5))"


@query("p12_signal_groups", f"""{ctes('reports', 'event_long')}, {signals._MEMBERS[:-1]} union all select record_id, 'influence', len(vaccines) > 1, analytic_year from reports where {signals._T}),
x as (select design, event, count(*) filter (target and present) as a, count(*) filter (target and not present) as b, count(*) filter (not target and present) as c, count(*) filter (not target and not present) as d from members join event_long using (record_id) group by 1, 2),
f as (select design, event, a >= 3 and {_IC} > 0 as sig from x)
select event, count(distinct design) filter (sig and design <> 'influence') as n_designs, count(distinct design) filter (sig and design <> 'influence') = (select count(distinct design) from x where design <> 'influence') as robust,
  bool_or(sig and design = 'influence') as influence, event in ('ev_returned', 'ev_bulk') as expected, event not in ('ev_returned', 'ev_bulk') as emerging from f group by event having bool_or(sig and design = 'others')
""")
def _p12(spark, sf):
    r = V.reports(spark, sf).where(F.array_contains("vaccines", V.TARGET))
    influence = r.select("record_id", (F.size("vaccines") > 1).alias("target"), F.col("analytic_year").alias("year"), F.lit("influence").alias("design"), *V.EVENTS)
    d = G.two_by_two_of(signals.members(spark, sf).unionByName(G.with_events(influence, V.EVENTS))).withColumns(G.information())
    expected = spark.createDataFrame([("ev_returned",), ("ev_bulk",)], "event string")  # a declared list
    return S.signal_groups(d.withColumn("on", F.expr("a >= 3 and ic > 0")), "on", "others", "influence", expected)


@query("x14_public_schema_drift", tables._MATCH + """, d as (select field, count(distinct file) as n_files, count(distinct file) = (select count(distinct file) from m) as in_all from m where field is not null group by 1)
select field, in_all, n_files as n from d where field <> 'second' union all select null, false, count(*) from d where field = 'second' and not in_all""")
def _x14(spark, sf):
    return S.public_drift(files.schema_drift(tables._headers(spark, sf)), ["second"])
