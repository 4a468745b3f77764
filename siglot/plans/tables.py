"""Queries of de-duplication, derived variables, data quality and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siglot.operators import curation as C
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes, table
from siglot.sources import files

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query("d1_exact_dedup", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(_LINE_ORDER)}) as n from lineitem) where n = 1
""")
def _d1(spark, sf):
    return C.exact_dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("d2_key_dedup_merge", f"""
select l_orderkey, l_linenumber, bool_or(case l_returnflag when 'R' then true when 'A' then false end) as returned, cast(min(cast(l_shipdate as date)) as varchar) as shipped,
  arg_min(case when l_tax > 0.02 then l_partkey end, row(l_partkey, l_suppkey)) filter (l_tax > 0.02) as part, count(*) as n_merged
from lineitem group by 1, 2
""")
def _d2(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("returned"),
        F.to_date("l_shipdate").cast("string").alias("shipped"), F.when(F.col("l_tax") > 0.02, F.col("l_partkey")).alias("part"), F.struct("l_partkey", "l_suppkey").alias("at"),
    )
    return C.key_dedup(df, ["l_orderkey", "l_linenumber"], ["returned"], ["shipped"], ["part"], F.col("at"))


@query("d3_dedup_log", "select count(*) as rows_in, count(distinct (l_orderkey, l_linenumber)) as rows_out, cast(count(*) - count(distinct (l_orderkey, l_linenumber)) as bigint) as removed from lineitem")
def _d3(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("rows_in"), F.countDistinct("l_orderkey", "l_linenumber").alias("rows_out")).withColumn("removed", F.col("rows_in") - F.col("rows_out"))


@query("d4_analytic_year", """
with t as (select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_shipdate end as a, case when l_linenumber % 2 <> 0 then o_orderdate end as b, 1994 as fy from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, cast(coalesce(year(a), year(b), fy) as integer) as year, case when a is not null then 'primary' when b is not null then 'other' else 'file' end as source from t
""")
def _d4(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_linenumber")
    year, source = C.analytic_year(F.when(k % 3 != 0, F.col("l_shipdate")), F.when(k % 2 != 0, F.col("o_orderdate")), F.lit(1994))
    return lines.select("l_orderkey", "l_linenumber", year.alias("year"), source.alias("source"))


@query("d5_open_window", ctes("reports") + " select record_id, analytic_year between 1997 and (select max(analytic_year) from reports) as in_window from reports")
def _d5(spark, sf):
    r = V.reports(spark, sf)
    return r.withColumn("_last", r.select(F.max("analytic_year")).scalar()).select("record_id", F.col("analytic_year").between(1997, F.col("_last")).alias("in_window"))


@query("d6_positional_target", ctes("reports") + f""", t as (select record_id, vaccines, list_transform(vaccines[1:case when record_id % 3 = 0 then 1 else len(vaccines) end], lambda x: 'L' || x) as lots, list_position(vaccines, '{V.TARGET}') as pos from reports)
select record_id, case when pos is null or pos = 0 then null when len(vaccines) = 1 or len(lots) = 1 then lots[1] else lots[pos] end as lot,
  case when pos is null or pos = 0 then 'none' when len(vaccines) = 1 then 'single_vaccine' when len(lots) = len(vaccines) then 'positional' when len(lots) = 1 then 'single_vaccine' else 'ambiguous' end as lot_assignment from t
""")
def _d6(spark, sf):
    r = V.reports(spark, sf)
    lots = F.transform(F.slice("vaccines", F.lit(1), F.when(F.col("record_id") % 3 == 0, 1).otherwise(F.size("vaccines"))), lambda x: F.concat(F.lit("L"), x))
    value, how = C.positional(F.col("vaccines"), V.TARGET, lots)
    return r.select("record_id", value.alias("lot"), how.alias("lot_assignment"))


@query("d7_coadministration", ctes("reports") + f" select record_id, cast(len(vaccines) as integer) as n_vaccines, len(vaccines) > 1 as coadministered, len(vaccines) = 1 and vaccines[1] = '{V.TARGET}' as target_only from reports")
def _d7(spark, sf):
    n = F.size("vaccines")
    return V.reports(spark, sf).select("record_id", n.alias("n_vaccines"), (n > 1).alias("coadministered"), ((n == 1) & F.array_contains("vaccines", V.TARGET)).alias("target_only"))


_SCHEDULE = {"1": (2, 3, 5), "2": (4, 5, 8), "3": (6, 7, 20)}


@query("d8_schedule_status", """
with t as (select l_orderkey, l_linenumber, l_quantity as age, l_returnflag = 'A' as exact, case l_linenumber when 6 then 'R' when 7 then 'U' else cast(l_linenumber as varchar) end as dose from lineitem),
u as (select *, case when exact then age else age + case when age >= 12 then 12 else 1 end end as upper, case dose when '1' then 2 when '2' then 4 when '3' then 6 end as least, case dose when '1' then 3 when '2' then 5 when '3' then 7 end as lo, case dose when '1' then 5 when '2' then 8 when '3' then 20 end as hi from t)
select l_orderkey, l_linenumber, case when dose = 'U' then 'unknown_dose' when dose = 'R' then 'booster_campaign' when dose not in ('1', '2', '3') then 'dose_not_in_schedule'
  when upper < least then 'too_young' when age > 48 then 'above_indication' when age < lo then 'early' when age < hi then 'on_schedule' else 'late' end as status from u
""")
def _d8(spark, sf):
    k = F.col("l_linenumber")
    dose = F.when(k == 6, "R").when(k == 7, "U").otherwise(k.cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.schedule_status(F.col("l_quantity"), F.col("l_returnflag") == "A", dose, _SCHEDULE, 4).alias("status"))


_COMP = ", ".join(f"'{x}'" for x in V.COMPARATORS)


@query("d9_comparator_flags", ctes("reports") + f"""
select record_id, not list_contains(vaccines, '{V.TARGET}') and len(list_intersect(vaccines, [{_COMP}])) > 0 as comparator,
  not list_contains(vaccines, '{V.TARGET}') and len(list_intersect(vaccines, [{_COMP}])) > 0 and len(list_intersect(vaccines, [{_COMP}])) < len(vaccines) as concomitant_non_comparator from reports
""")
def _d9(spark, sf):
    shared = F.size(F.array_intersect("vaccines", F.array(*[F.lit(x) for x in V.COMPARATORS])))
    comparator = ~F.array_contains("vaccines", V.TARGET) & (shared > 0)
    return V.reports(spark, sf).select("record_id", comparator.alias("comparator"), (comparator & (shared < F.size("vaccines"))).alias("concomitant_non_comparator"))


@query("d10_population", ctes("reports") + f" select record_id from reports where analytic_year between 1996 and 2000 and (list_contains(vaccines, '{V.TARGET}') and not ev_big or len(list_intersect(vaccines, [{_COMP}])) > 0)")
def _d10(spark, sf):
    comparator = F.arrays_overlap("vaccines", F.array(*[F.lit(x) for x in V.COMPARATORS]))
    return V.reports(spark, sf).where(F.col("analytic_year").between(1996, 2000)).where((F.array_contains("vaccines", V.TARGET) & ~F.col("ev_big")) | comparator).select("record_id")


@query("d11_event_counts", ctes("reports") + " select record_id, cast(ev_returned as int) + cast(ev_urgent as int) + cast(ev_bulk as int) + cast(ev_open as int) + cast(ev_big as int) as n_events, ev_returned or ev_urgent as any_serious, ev_big or ev_bulk as any_rare from reports")
def _d11(spark, sf):
    n = sum((F.col(e).cast("int") for e in V.EVENTS[1:]), F.col(V.EVENTS[0]).cast("int"))
    return V.reports(spark, sf).select("record_id", n.alias("n_events"), (F.col("ev_returned") | F.col("ev_urgent")).alias("any_serious"), (F.col("ev_big") | F.col("ev_bulk")).alias("any_rare"))


@query("d12_delays_and_bands", """
select l_orderkey, l_linenumber, cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as integer) as delay, case when l_quantity < 2 then 0 when l_quantity < 4 then 1 when l_quantity < 6 then 2 when l_quantity < 12 then 3 when l_quantity < 24 then 4 when l_quantity < 72 then 5 end as band
from lineitem join orders on l_orderkey = o_orderkey
""")
def _d12(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select("l_orderkey", "l_linenumber", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("delay"), C.age_band(F.col("l_quantity")).alias("band"))


_FLAGS = {"tax_over_discount": "l_tax > l_discount", "bulk": "l_quantity >= 45", "cheap": "l_extendedprice < 5000", "late": "l_shipdate > timestamp '1999-01-01'", "unknown_null": "nullif(l_discount, 0) > 0.05"}


def _flag_sql(name: str, cond: str) -> str:
    return f"select l_returnflag, '{name}' as flag, count(*) as n, count(*) filter ({cond}) as flagged, round(100.0 * count(*) filter ({cond}) / count(*), 4) as pct from lineitem group by 1"


@query("d13_d14_plausibility", " union all ".join(_flag_sql(k, c) for k, c in _FLAGS.items()))
def _d14(spark, sf):
    return C.plausibility(table(spark, sf, "lineitem"), "l_returnflag", {k: F.expr(c) for k, c in _FLAGS.items()})


_REPORT = """with r as (select o_orderkey as k, cast(o_orderdate as date) as notification_date, cast(o_orderdate as date) - cast(o_orderkey % 800 - 30 as integer) as vaccination_date,
  cast(o_orderdate as date) - cast(o_custkey * 37 % 12000 as integer) as birth_date, o_orderstatus = 'F' as hospitalized, o_orderpriority, o_totalprice from orders),
d as (select *, case when k % 3 > 0 then notification_date + cast(k % 11 - 5 as integer) end as admission_date, case when k % 3 > 0 then notification_date + cast(k % 11 - 5 + (k % 420) - 3 as integer) end as discharge_date,
  case when k % 13 > 0 then date_diff('day', birth_date, vaccination_date) / 30.4375 end as age_months from r)"""
_CONDITIONS = {
    "notification_before_vaccination": "notification_date < vaccination_date", "notification_delay_implausible": "date_diff('day', vaccination_date, notification_date) > 730", "birth_after_vaccination": "birth_date > vaccination_date",
    "discharge_before_admission": "discharge_date < admission_date", "stay_implausible": "date_diff('day', admission_date, discharge_date) > 365", "admission_before_vaccination": "admission_date < vaccination_date",
    "age_conflict": "k % 17 = 3", "age_missing": "age_months is null", "age_group_mismatch": "k % 5 = 1",
    "hospitalized_without_date": "hospitalized and admission_date is null", "admission_date_not_hospitalized": "not hospitalized and admission_date is not null",
    "pregnant_male": "k % 9 = 2 and k % 2 = 0", "pregnant_age_implausible": "k % 9 = 2 and not coalesce(floor(age_months / 12) between 10 and 55, false)",
    "recovered_and_died": "k % 7 = 0 and k % 8 = 0", "no_event_marked": "k % 6 = 0 and k % 4 <> 1",
    "unmapped_vaccine": "k % 19 = 4", "target_lot_missing": "k % 10 = 5 and k % 3 = 0", "schedule_invalid": "k % 23 = 0",
    "vaccination_year_imputed": "k % 20 = 1", "vaccination_year_dropped": "k % 20 = 2", "notification_year_imputed": "k % 20 = 3", "notification_year_dropped": "k % 20 = 4",
    "month_mismatch": "k % 12 + 1 <> month(vaccination_date) and k % 12 + 1 <> month(notification_date) and k % 2 = 0",
}


@query("d13_plausibility_flags", _REPORT + " union all ".join(f" select '{f}' as flag, count(*) as n, count(*) filter ({c}) as flagged, round(100.0 * count(*) filter ({c}) / count(*), 4) as pct from d" for f, c in _CONDITIONS.items()))
def _d13(spark, sf):
    k = F.col("o_orderkey")
    day = lambda d, n: F.date_add(d, n.cast("int"))
    d = table(spark, sf, "orders").withColumn("notification_date", F.to_date("o_orderdate"))
    d = d.withColumns({"vaccination_date": day(F.col("notification_date"), -(k % 800 - 30)), "birth_date": day(F.col("notification_date"), -(F.col("o_custkey") * 37 % 12000)), "hospitalized": F.col("o_orderstatus") == "F"})
    d = d.withColumns({
        "admission_date": F.when(k % 3 > 0, day(F.col("notification_date"), k % 11 - 5)), "discharge_date": F.when(k % 3 > 0, day(F.col("notification_date"), k % 11 - 8 + k % 420)),
        "age_months": F.when(k % 13 > 0, F.datediff("vaccination_date", "birth_date") / 30.4375), "age_source": F.when(k % 17 == 3, "conflict_derived").otherwise("both_agree"),
        "age_group": F.lit("0-5"), "age_group_reported": F.when(k % 5 == 1, "61+").when(k % 5 == 2, None).otherwise("0-5"), "pregnant": F.when(k % 9 == 2, True).when(k % 9 == 3, None).otherwise(False),
        "sex": F.when(k % 2 == 0, "M").otherwise("F"), "recovered": k % 7 == 0, "died": F.when(k % 8 == 0, True).when(k % 8 == 1, None).otherwise(False), "n_events": k % 6, "other_categories": F.when(k % 4 == 1, "x"),
        "vaccines": F.when(k % 19 == 4, F.array(F.lit("A"), F.lit("X:B"))).otherwise(F.array(F.lit("A"))), "has_target": k % 10 == 5, "target_lots": F.when(k % 3 > 0, "l"), "schedule_invalid": k % 23 == 0,
        "vaccination_date_rule": F.when(k % 20 == 1, "imputed_year").when(k % 20 == 2, "dropped_impossible").otherwise("kept"), "notification_date_rule": F.when(k % 20 == 3, "imputed_year").when(k % 20 == 4, "dropped_impossible").otherwise("kept"),
        "month_reported": F.when(k % 2 == 0, k % 12 + 1),
    })
    return C.plausibility(d.withColumn("every", F.lit("all")), "every", C.plausibility_flags()).drop("every")


@query("d15_conformance", """
with t as (select l_returnflag, case when l_discount = 0 then 'missing' when l_discount > 0.08 then 'invalid' else 'ok' end as discount, case when l_tax = 0 then 'missing' else 'ok' end as tax from lineitem)
select l_returnflag, field, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'missing') as missing, count(*) filter (status = 'invalid') as invalid
from (select l_returnflag, 'discount' as field, discount as status from t union all select l_returnflag, 'tax', tax from t) group by 1, 2
""")
def _d15(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    status = {"discount": F.when(d == 0, "missing").when(d > 0.08, "invalid").otherwise("ok"), "tax": F.when(t == 0, "missing").otherwise("ok")}
    return C.conformance(table(spark, sf, "lineitem"), "l_returnflag", status, ["ok", "missing", "invalid"])


@query("d16_completeness", "with t as (select lang, nullif(n_chars % 3, 0) as a, nullif(source, 'src0') as b from documents) select lang, 'a' as field, count(*) as n, count(a) as filled, round(100.0 * count(a) / count(*), 4) as pct from t group by 1 union all select lang, 'b', count(*), count(b), round(100.0 * count(b) / count(*), 4) from t group by 1")
def _d16(spark, sf):
    df = table(spark, sf, "documents").select("lang", F.nullif(F.col("n_chars") % 3, F.lit(0)).alias("a"), F.nullif("source", F.lit("src0")).alias("b"))
    return C.completeness(df, "lang", ["a", "b"])


@query("d17_administrations", ctes("reports") + " select record_id, unnest(vaccines) as vaccine, cast(generate_subscripts(vaccines, 1) as integer) as position from reports")
def _d17(spark, sf):
    return V.reports(spark, sf).select("record_id", F.posexplode("vaccines").alias("p", "vaccine")).select("record_id", "vaccine", (F.col("p") + 1).alias("position"))


@query("d18_event_long", ctes("reports", "event_long") + " select record_id, event, present from event_long")
def _d18(spark, sf):
    return V.event_long(spark, sf)


@query("d19_outcomes", ctes("reports") + " select record_id, hospitalized from reports")
def _d19(spark, sf):
    return V.reports(spark, sf).select("record_id", "hospitalized")


@query("d20_recorded_mask", """
with seen as (select distinct source as source_file, lang as event from documents)
select event from seen group by event having count(distinct source_file) = (select count(distinct source_file) from seen)
""")
def _d20(spark, sf):
    return C.recorded_everywhere(table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("event")).distinct())


_MONTHS = """with t as (select cast(year(l_shipdate) as integer) as y, cast(month(l_shipdate) as integer) as m from lineitem), c as (select y, m, count(*) as n from t group by 1, 2),
p as (select c.y, min(m) as lo, max(m) as hi from c join (select y, median(n) as med from c group by 1) using (y) where n >= greatest(1, 0.1 * med) group by 1),
g as (select y, unnest(range(1, 13)) as m from (select distinct y from t)),
f as (select g.y as year, cast(g.m as integer) as month, coalesce(c.n, 0) as n_reports, coalesce(g.m between lo and hi, false) as observed from g left join c on c.y = g.y and c.m = g.m left join p on p.y = g.y)
"""


def _coverage(spark, sf):
    return C.month_coverage(table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")), "year", "month")


@query("d21_month_coverage", _MONTHS + "select year, month, n_reports, observed from f")
def _d21(spark, sf):
    return _coverage(spark, sf)


@query("d22_partial_years", _MONTHS + "select year, count(*) filter (observed) as observed_months from f group by 1 having count(*) filter (observed) < 12")
def _d22(spark, sf):
    return C.partial_years(_coverage(spark, sf), "year")


@query("d23_population_flow", ctes("reports") + f"""
select count(*) as reports, count(*) filter (analytic_year >= 1997) as in_window, count(*) filter (list_contains(vaccines, '{V.TARGET}')) as target, count(*) filter (list_contains(vaccines, '{V.TARGET}') and not ev_big) as valid_target,
  count(*) filter (not list_contains(vaccines, '{V.TARGET}') and len(list_intersect(vaccines, [{_COMP}])) > 0) as comparator from reports
""")
def _d23(spark, sf):
    target = F.array_contains("vaccines", V.TARGET)
    comparator = ~target & F.arrays_overlap("vaccines", F.array(*[F.lit(x) for x in V.COMPARATORS]))
    return V.reports(spark, sf).agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("analytic_year") >= 1997).alias("in_window"), F.count_if(target).alias("target"), F.count_if(target & ~F.col("ev_big")).alias("valid_target"), F.count_if(comparator).alias("comparator"))


# Sources


@query("s2_read_raw_round_trip", "select p_partkey, p_name, p_brand, p_size from part")
def _s2(spark, sf):
    return files.csv_round_trip(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


@query("s5_junk_columns", "select lang, count(nullif(source, 'src1')) as junk, count(*) filter (coalesce(nullif(source, 'src1'), nullif(n_chars % 2, 0)::varchar) is not null) as not_blank from documents group by 1")
def _s5(spark, sf):
    df = table(spark, sf, "documents").select("lang", F.nullif("source", F.lit("src1")).alias("a"), F.nullif(F.col("n_chars") % 2, F.lit(0)).cast("string").alias("b"))
    return df.groupBy("lang").agg(F.count("a").alias("junk"), F.count_if(F.coalesce("a", "b").isNotNull()).alias("not_blank"))


@query("s6_union_drifting_schema", """
select 'orders' as file, o_orderkey as id, o_totalprice as amount, null as segment, 'absent_column' as segment_status from orders
union all select 'customer', c_custkey, c_acctbal, c_mktsegment, 'ok' from customer
""")
def _s6(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))
    return files.union_drifting({"orders": a, "customer": b}, ["segment"])


@query("s11_composite_lot_key", "select l_suppkey, l_partkey, l_orderkey, l_linenumber, case when count(*) over (partition by l_suppkey) > 1 then l_suppkey || '@' || year(l_shipdate) || '#' || row_number() over (partition by l_suppkey, year(l_shipdate) order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) else l_suppkey::varchar end as lot_key from lineitem")
def _s11(spark, sf):
    y = F.year("l_shipdate")
    n = F.row_number().over(Window.partitionBy("l_suppkey", y).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    key = F.when(F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")) > 1, F.concat(F.col("l_suppkey"), F.lit("@"), y, F.lit("#"), n)).otherwise(F.col("l_suppkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", key.alias("lot_key"))


@query("s12_lot_destinations", "select distinct l_suppkey, l_returnflag as destination from lineitem")
def _s12(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("d"))
    return per.select("l_suppkey", F.explode(F.array_distinct("d")).alias("destination"))


@query("s13_spec_drift", """
with a as (select p_brand, max(p_size) as high from part where p_brand <> 'Brand#11' group by 1), b as (select p_brand, max(p_size + case when p_brand like '%3' then 1 else 0 end) as high from part where p_brand <> 'Brand#55' group by 1)
select coalesce(a.p_brand, b.p_brand) as attribute, case when a.high is null then 'only_documented' when b.high is null then 'only_sheet' when abs(a.high - b.high) <= 1e-9 * greatest(abs(a.high), abs(b.high)) then 'same' else 'changed' end as drift from a full join b on a.p_brand = b.p_brand
""")
def _s13(spark, sf):
    part = table(spark, sf, "part")
    a = part.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("attribute")).agg(F.max("p_size").alias("a"))
    b = part.where("p_brand <> 'Brand#55'").groupBy(F.col("p_brand").alias("attribute")).agg(F.max(F.col("p_size") + F.when(F.col("p_brand").endswith("3"), 1).otherwise(0)).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"))
    drift = F.when(F.col("a").isNull(), "only_documented").when(F.col("b").isNull(), "only_sheet").when(near, "same").otherwise("changed")
    return a.join(b, "attribute", "full").select("attribute", drift.alias("drift"))


@query("s14_parquet_round_trip", "select c_custkey, c_nationkey from customer")
def _s14(spark, sf):
    return files.parquet_round_trip(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@query("s16_json_objects")
def _s16(spark, sf):
    part = table(spark, sf, "part")
    bad = F.when(F.col("p_size") == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return part.select("p_partkey", files.json_object({"price": bad, "name": F.col("p_name")}).alias("json"))


@query("s17_fingerprints")
def _s17(spark, sf):
    return files.fingerprints(spark, f"{sf}/documents.parquet")


@query("s1_discover_files")
def _s1(spark, sf):
    return files.discover(spark, f"{sf}/documents.parquet", r"(\w+)\.parquet")


@query("s3_header_row")
def _s3(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("part").alias("file"), F.col("p_partkey").alias("row"), F.array("p_name", "p_brand", "p_type").alias("cells"))
    aliases = spark.createDataFrame([("Brand#13",), ("PROMO",)], "alias string")
    return files.header_row(rows, aliases, first_rows=1_000_000, least=1)


@query("s9_annual_series", "select cast(year(o_orderdate) as integer) as year, count(*) as cases, round(sum(o_totalprice), 2) as amount from orders where year(o_orderdate) between 1900 and 2100 group by 1")
def _s9(spark, sf):
    df = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    return files.annual_series(df, "year")


_HEAD = "with h as (select lang as file, source as header, row_number() over (partition by lang, source order by doc_id) as occurrence from documents)"


def _headers(spark, sf):
    h = table(spark, sf, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("position"), F.col("source").alias("header"))
    aliases = spark.createDataFrame([("first", "src1", 1, None), ("second", "src1", 2, None), ("pattern", None, None, "src[23]")], "field string, alias string, occurrence int, pattern string")
    return files.match_headers(h, aliases)


_MATCH = _HEAD + " , m as (select *, case when header = 'src1' and occurrence = 1 then 'first' when header = 'src1' and occurrence = 2 then 'second' when header in ('src2', 'src3') then 'pattern' end as field, case when header = 'src1' and occurrence <= 2 then 'exact' when header in ('src2', 'src3') then 'pattern' else 'unmatched' end as how from h)"


@query("s4_match_headers", _MATCH + " select file, header, field, how, count(*) as n from m group by all")
def _s4(spark, sf):
    return _headers(spark, sf).groupBy("file", "header", "field", "how").agg(F.count(F.lit(1)).alias("n"))


@query("s7_schema_drift", _MATCH + " select field, count(distinct file) as n_files, bool_or(how <> 'exact') as inexact, count(distinct file) = (select count(distinct file) from m) as in_all from m where field is not null group by 1")
def _s7(spark, sf):
    return files.schema_drift(_headers(spark, sf))


@query("s8_split_spec_row", "select l_suppkey, count(*) filter (l_tax = 0 and l_discount = 0) as spec_rows, count(*) filter (not (l_tax = 0 and l_discount = 0)) as data_rows from lineitem group by 1")
def _s8(spark, sf):
    from siglot.operators.parsing import spec

    cells = [F.when(F.col(c) == 0, "≥ 80 %").otherwise(F.col(c).cast("string")) for c in ("l_tax", "l_discount")]
    limits = sum(((spec(c)["op"] != "qualitative").cast("int") for c in cells[1:]), (spec(cells[0])["op"] != "qualitative").cast("int"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(limits >= 2).alias("spec_rows"), F.count_if(limits < 2).alias("data_rows"))


@query("s10_lots_table", "select p_partkey, p_size as value, regexp_matches(p_brand, '[0-9]') as has_id, lower(p_type) like 'standard%' or lower(p_type) like 'promo%' as passed, contains(p_name, 'bolt') as national from part")
def _s10(spark, sf):
    kind = F.lower("p_type")
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value"), F.col("p_brand").rlike(r"\d").alias("has_id"), (F.startswith(kind, F.lit("standard")) | F.startswith(kind, F.lit("promo"))).alias("passed"), F.array_contains(F.split("p_name", " "), "bolt").alias("national"))


@query("s15_release_table", "select l_returnflag, cast(count(*) as integer) as n, round(avg(l_tax), 6) as mean from lineitem group by 1")
def _s15(spark, sf):
    path = files.scratch(spark)
    d = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("mean"))
    files.write_table(d, path)
    return spark.read.schema("l_returnflag string, n int, mean double").csv(path, header=True)


@query("s19_step_log", "select 'read' as step, count(*) as n_rows from lineitem union all select 'in_window', count(*) from lineitem where l_shipdate >= timestamp '1997-01-01'")
def _s19(spark, sf):
    from pyspark.sql import Observation

    a, b = Observation("read"), Observation("in_window")
    d = table(spark, sf, "lineitem").select("l_shipdate").observe(a, F.count(F.lit(1)).alias("n")).where("l_shipdate >= timestamp '1997-01-01'").observe(b, F.count(F.lit(1)).alias("n"))
    d.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("read", a.get["n"]), ("in_window", b.get["n"])], "step string, n_rows bigint")


@query("c22_multi_codes", ctes("reports") + " select record_id, list_transform(vaccines, lambda x: case when x like 'Brand#1%' then 'ONE' when x like 'Brand#2%' then 'TWO' else 'OTHER' end) as codes from reports")
def _c22(spark, sf):
    code = lambda x: F.when(x.startswith("Brand#1"), "ONE").when(x.startswith("Brand#2"), "TWO").otherwise("OTHER")
    return V.reports(spark, sf).select("record_id", F.transform("vaccines", code).alias("codes"))


@query("x14_public_drift", "select case when source in ('src1', 'src2') then 'identifiers' else source end as name, count(*) as n from documents group by 1")
def _x14(spark, sf):
    name = F.when(F.col("source").isin("src1", "src2"), "identifiers").otherwise(F.col("source"))
    return table(spark, sf, "documents").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
