"""Queries of lot sheets, their scales and flagged lots, of designs and of keyed identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import lots as O
from siglot.operators import models as R
from siglot.operators import monitoring
from siglot.operators.pseudonyms import TEST_KEY, Pseudonyms
from siglot.plans import quality
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes, table

_COLUMNS = {"lot_id": 0, "production_year": 1, "price": 2, "size": 3, "look": 4, "destinations": 5}
_NUMBERS = ["price", "size"]
_PART = """p as (select p_brand as file, p_partkey as part, case when p_partkey % 37 = 0 then 'NOTA' else p_type || ' ' || p_partkey end as lot, 1990 + p_size % 9 as year, p_retailprice as price, p_size as size,
  case p_partkey % 5 when 0 then null when 1 then 'No cumple' else 'Cumple con lo establecido' end as look, case p_partkey % 3 when 0 then 'Perú; Cuba' when 1 then 'Brasil' end as dest from part)"""
_STATED = "regexp_matches(file, '[0-3]$')"


def _sheets(spark, sf):
    """A sheet per brand: its limits in row 0, where it states them, and a row per part."""
    part = table(spark, sf, "part")
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    look = F.when(k % 5 == 0, None).when(k % 5 == 1, "No cumple").otherwise("Cumple con lo establecido")
    dest = F.when(k % 3 == 0, "Perú; Cuba").when(k % 3 == 1, "Brasil")
    lot = F.when(k % 37 == 0, "NOTA").otherwise(F.concat_ws(" ", "p_type", text("p_partkey")))
    rows = part.select(F.col("p_brand").alias("file"), (k + 1).alias("row"), F.array(lot, (1990 + F.col("p_size") % 9).cast("string"), text("p_retailprice"), text("p_size"), look, dest).alias("cells"))
    heads = part.select(F.col("p_brand").alias("file")).distinct().where(F.col("file").rlike("[0-3]$"))
    limits = [F.lit(x).cast("string") for x in (None, None, "≥ 900,5", "(40 - 1)", "Cumple", None)]
    return rows.unionByName(heads.select("file", F.lit(0).cast("bigint").alias("row"), F.array(*limits).alias("cells"))).withColumn("start", F.when(F.col("file").rlike("[0-3]$"), 0).otherwise(1))


def _documented(spark):
    return spark.createDataFrame([("price", "ge", 905.0, None, None), ("size", "range", 1.0, 40.0, None)], "attribute string, op string, low double, high double, unit string")


@query("s8_sheet_specs", f"""
with {_PART}, f as (select distinct file from p)
select file, 'price' as attribute, 'ge' as op, case when {_STATED} then 900.5 else 905.0 end as low, cast(null as double) as high, case when {_STATED} then 'sheet' else 'documented' end as source, true as drift from f
union all select file, 'size', 'range', 1.0, 40.0, case when {_STATED} then 'sheet' else 'documented' end, not {_STATED} from f
""")
def _s8(spark, sf):
    grid = _sheets(spark, sf)
    limits, _ = O.split_spec_row(grid, _COLUMNS, _NUMBERS)
    return O.sheet_specs(grid, limits, _COLUMNS, _NUMBERS, _documented(spark)).drop("unit")


@query("s10_lots_of_sheets", f"""
with {_PART} select file, part + 1 as row, lot as lot_id, regexp_replace(upper(lot), '[^0-9A-Z]', '', 'g') as lot_exact, cast(year as integer) as production_year, price, cast(size as double) as size, upper(look) as look_text, look <> 'No cumple' as look_pass,
  case when dest like 'Per%' then ['CU', 'OTHER'] when dest is not null then ['BR'] end as destination_codes, coalesce(dest like '%Cuba', false) as national, cast(case when dest like 'Per%' then 2 when dest is not null then 1 else 0 end as integer) as n_destinations
from p where lot <> 'NOTA'
""")
def _s10(spark, sf):
    _, data = O.split_spec_row(_sheets(spark, sf), _COLUMNS, _NUMBERS)
    code = lambda t: F.when(t == "CUBA", "CU").when(t == "BRASIL", "BR")
    return O.lots_table(data, _COLUMNS, _NUMBERS, {"look": ["CUMPLE"]}, code, "CU").drop("lot_core")


@query("q2_scales_of_limits", """
with m as (select min(l_quantity) as q0, max(l_quantity) as q1, min(l_extendedprice) as p0, max(l_extendedprice) as p1 from lineitem)
select 'l_quantity' as attribute, 'le' as op, cast(null as double) as low, round(log10(45), 6) as high, round(log10(q0), 6) as window_low, round(log10(45), 6) as window_high, 'upper' as one_sided from m
union all select 'l_extendedprice', 'ge', 1000, null, 1000, p1, 'lower' from m union all select 'l_discount', 'range', 0.01, 0.09, 0.01, 0.09, null from m union all select 'l_tax', 'ge', 0.09, null, 0.09, 1.09, 'lower' from m
""")
def _q2(spark, sf):
    rows = [("l_quantity", "le", None, 45.0), ("l_extendedprice", "ge", 1000.0, None), ("l_discount", "range", 0.01, 0.09), ("l_tax", "ge", 0.09, None), ("l_comment", "qualitative", None, None)]
    specs = spark.createDataFrame(rows, "attribute string, op string, low double, high double")
    d = O.attribute_scales(specs, table(spark, sf, "lineitem"), V.ATTRIBUTES, {"l_quantity": "log10"}, {"l_tax": (0.0, 0.08)})
    return d.select("attribute", "op", *[F.round(c, 6).alias(c) for c in ("low", "high", "window_low", "window_high")], "one_sided")


@query("q17_flagged_by_year")
def _q17(spark, sf):
    rows, m = quality._monitor(spark, sf, True)
    return monitoring.flagged_by(m.scores(rows.withColumn("production_year", F.year("l_shipdate"))), "production_year")


@query("q17_contributors_of_flagged")
def _q17b(spark, sf):
    rows, m = quality._monitor(spark, sf, True)
    return monitoring.top_contributors(m.scores(rows), m.columns)


@query("q19_shift_interval", """
with d as (select p_brand, p_type, avg(p_retailprice) as v from part group by 1, 2), p as (select a.p_brand, list_sort(list(a.v - b.v)) as d from d a join d b on a.p_brand = b.p_brand and a.p_type < 'M' and b.p_type >= 'M' group by 1),
n as (select p_brand, count(*) filter (p_type < 'M') as n_x, count(*) filter (p_type >= 'M') as n_y from d group by 1),
k as (select *, cast(greatest(0, least(floor(n_x * n_y / 2.0 - 1.959963984540054 * sqrt(n_x * n_y * (n_x + n_y + 1) / 12.0)), n_x * n_y - 1)) as bigint) as k from n)
select p_brand, n_x, n_y, round(list_aggregate(d, 'median'), 4) as shift, round(d[k + 1], 4) as low, round(d[n_x * n_y - k], 4) as high from p join k using (p_brand)
""")
def _q19(spark, sf):
    d = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"))
    return R.hodges_lehmann(d, ["p_brand"], "v", F.col("p_type") < "M").withColumns({c: F.round(c, 4) for c in ("shift", "low", "high")})


_AGE = "case when record_id % 5 > 0 then record_id % 97 end"


def _report_design(spark, sf):
    d = V.reports(spark, sf).withColumns({"age": F.expr(_AGE), "outcome": F.when(F.col("record_id") % 11 > 0, F.col("hospitalized")), "never": F.lit(False), "n_events": F.col("ev_returned").cast("int") + F.col("ev_urgent").cast("int") + F.col("ev_bulk").cast("int")})
    products = {"product_target": F.array_contains("vaccines", V.TARGET), "product_none": F.array_contains("vaccines", "none"), "coadministered": F.size("vaccines") > 1}
    return R.report_design(d, "outcome", "age", products, ["ev_returned", "ev_urgent", "ev_bulk", "never"], ["n_events"])


@query("m1_design_terms", ctes("reports") + f""", d as (select *, ln(1 + {_AGE}) as a from reports where record_id % 11 > 0), m as (select coalesce(a, (select quantile_cont(a, 0.5) from d)) as age_log, cast(a is null as int) as age_missing, cast(list_contains(vaccines, '{V.TARGET}') as int) as product_target,
  cast(len(vaccines) > 1 as int) as coadministered, cast(ev_returned as int) as x_ev_returned, cast(ev_urgent as int) as x_ev_urgent, cast(ev_bulk as int) as x_ev_bulk, cast(ev_returned as int) + cast(ev_urgent as int) + cast(ev_bulk as int) as x_n_events, cast(hospitalized as int) as y from d),
t as (unpivot (select y, columns(* exclude y)::double from m) on columns(* exclude y) into name term value v)
select term, count(*) as n, round(avg(v), 6) as mean, round(avg(v) filter (y = 1), 6) as mean_with, round(min(v), 6) as least, round(max(v), 6) as most from t group by 1
""")
def _m1(spark, sf):
    d, kept = _report_design(spark, sf)
    long = d.select("y", *[F.col(c).cast("double").alias(c) for c in kept]).unpivot(["y"], kept, "term", "v")
    r = lambda c: F.round(c, 6)
    return long.groupBy("term").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"), r(F.avg(F.when(F.col("y") == 1, F.col("v")))).alias("mean_with"), r(F.min("v")).alias("least"), r(F.max("v")).alias("most"))


@query("m4_logistic_table")
def _m4(spark, sf):
    d, kept = _report_design(spark, sf)
    return R.logistic_table(d, [c for c in kept if c != "x_n_events"])[0]


_PADS = [bytes(b ^ x for b in TEST_KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def _hmac(text: str, size: int) -> str:
    """DuckDB SQL of HMAC-SHA256 under the test key."""
    return f"substr(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode({text})))), 1, {size})"


_SEP = "chr(31)"
_NAME = "trim(regexp_replace(upper(c_name), '[^0-9A-Z]+', ' ', 'g'))"
_BIRTH = "case when c_custkey % 7 > 0 then cast(date '1960-01-01' + cast(c_custkey % 9000 as integer) as varchar) end"


@query("c25_person_ids", f"""
with t as (select c_custkey, {_NAME} as name, replace({_BIRTH}, '-', ' ') as birth, c_mktsegment as seg from customer)
select c_custkey, case when birth is null then 'W' || {_hmac(f"'weak' || {_SEP} || 'FILE 1' || {_SEP} || c_custkey", 20)} else 'P' || {_hmac(f"'person' || {_SEP} || name || {_SEP} || birth || {_SEP} || coalesce(nullif(seg, 'BUILDING'), '')", 20)} end as person_id,
  case when birth is null then 'weak' else 'strong' end as strength, 'R' || {_hmac(f"'record' || {_SEP} || 'FILE 1' || {_SEP} || c_custkey", 20)} as record_id, 'C' || {_hmac(f"'clinic' || {_SEP} || seg", 12)} as clinic from t
""")
def _c25(spark, sf):
    p = Pseudonyms(TEST_KEY, test_data=True)
    birth = F.when(F.col("c_custkey") % 7 > 0, F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")))
    person, strength = p.person(F.col("c_name"), birth, F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("file 1"), F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", person.alias("person_id"), strength.alias("strength"), p.record(F.lit("file 1"), F.col("c_custkey")).alias("record_id"), p.generic("clinic", F.col("c_mktsegment")).alias("clinic"))


@query("c24_keyed_row_digest", f"select c_custkey, {_hmac(f'''c_name || {_SEP} || c_nationkey || {_SEP} || coalesce(nullif(c_mktsegment, 'BUILDING'), '')''', 24)} as digest from customer")
def _c24(spark, sf):
    p = Pseudonyms(TEST_KEY, test_data=True)
    return table(spark, sf, "customer").select("c_custkey", p.row_digest(F.col("c_name"), F.col("c_nationkey"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("digest"))
