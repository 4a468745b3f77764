"""Queries of joins and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import linkage as L
from siglot.operators import parsing as P
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes, table


@query("j1_left_join", "with n as (select year(o_orderdate) as y, count(*) as n from orders group by 1), d as (select year(l_shipdate) as y, sum(l_quantity) as doses from lineitem where year(l_shipdate) < 2000 group by 1) select cast(n.y as integer) as year, n, doses from n left join d on n.y = d.y")
def _j1(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf, "lineitem").where(F.year("l_shipdate") < 2000).groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("doses"))
    return n.join(d, "year", "left")


@query("j2_inner_join", ctes("reports", "administrations", "event_long") + " select vaccine, event, count(*) as n from administrations join event_long using (record_id) where present group by 1, 2")
def _j2(spark, sf):
    return V.administrations(spark, sf).join(V.event_long(spark, sf).where("present"), "record_id").groupBy("vaccine", "event").agg(F.count(F.lit(1)).alias("n"))


@query("j3_semi_join", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def _j3(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000")
    return table(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("j4_grid", ctes("reports", "administrations") + ", v as (select distinct vaccine from administrations), y as (select distinct analytic_year as year from reports), n as (select vaccine, analytic_year as year, count(*) as n from administrations join reports using (record_id) group by 1, 2) select vaccine, year, coalesce(n, 0) as n from v cross join y left join n using (vaccine, year)")
def _j4(spark, sf):
    d = V.reports(spark, sf).select(F.explode("vaccines").alias("vaccine"), F.col("analytic_year").alias("year"))
    n = d.groupBy("vaccine", "year").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("vaccine").distinct().crossJoin(F.broadcast(n.select("year").distinct()))  # products x years: two short lists
    return grid.join(n, ["vaccine", "year"], "left").na.fill(0, ["n"])


@query("j5_fuzzy_join")
def _j5(spark, sf):
    names = table(spark, sf, "part").select(F.upper("p_name").alias("name")).distinct()
    typed = names.select(F.concat(F.expr("substr(name, 1, 3)"), F.expr("substr(name, 5)")).alias("typed"))
    return L.fuzzy_join(typed, names, "typed", "name")


@query("j6_range_candidates", "select r.record_id, count(*) as n from (select o_orderkey as record_id, year(o_orderdate) as y, o_custkey % 100 + 1 as s from orders) r join (select distinct l_suppkey as s, year(l_shipdate) as y from lineitem) l on r.s = l.s and l.y between r.y - 2 and r.y group by 1")
def _j6(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 100 + 1).alias("s"))
    lots = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ls"), F.year("l_shipdate").alias("ly")).distinct()
    return r.join(lots, F.expr("s = ls and ly between y - 2 and y")).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


_LOTS = """lots as (select distinct cast(p_partkey as varchar) as lot_key, regexp_replace(upper(p_brand), '[^0-9A-Z]', '', 'g') || (p_size % 7) as exact, p_size % 2 = 0 as national, 1994 + p_size % 9 as year from part),
tokens as (select o_orderkey as record_id, 'BRAND' || (11 + o_custkey % 5) || (o_orderkey % 7) as exact, cast(year(o_orderdate) as integer) as report_year from orders)"""
_CHOICE = f"""with {_LOTS}, c as (select record_id, lot_key, national, year, report_year from tokens join lots using (exact)),
c1 as (select *, max(cast(national as int)) over (partition by record_id) as a from c), c2 as (select *, cast(year <= report_year as int) as past from c1 where a = 0 or national),
c3 as (select *, max(past) over (partition by record_id) as ap from c2), c4 as (select *, max(year) over (partition by record_id) as ly from c3 where ap = 0 or past = 1), ch as (select record_id, count(distinct lot_key) as n, min(lot_key) as lot from c4 where year = ly group by 1)"""


def _lots(spark, sf):
    exact = F.concat(P.exact_key(F.col("p_brand")), F.col("p_size") % 7)
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("lot_key"), exact.alias("exact"), P.core_key(exact).alias("core"), (F.col("p_size") % 2 == 0).alias("national"), (1994 + F.col("p_size") % 9).alias("year")).distinct()


def _tokens(spark, sf):
    exact = F.concat(F.lit("BRAND"), 11 + F.col("o_custkey") % 5, F.col("o_orderkey") % 7)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), exact.alias("exact"), P.core_key(exact).alias("core"), F.year("o_orderdate").alias("report_year"))


@query("j7_choose", _CHOICE + " select record_id, case when n = 1 then lot end as lot_key, case when n = 1 then 'unique' else 'ambiguous' end as choice from ch")
def _j7(spark, sf):
    # a record's candidates depend on its key and year alone: each distinct pair is chosen for once
    tokens = _tokens(spark, sf)
    asked = tokens.select("exact", "report_year").distinct()
    chosen = L.choose(asked.join(_lots(spark, sf).drop("core"), "exact"), ["exact", "report_year"], "lot_key", "national", "year", "report_year")
    return tokens.join(chosen, ["exact", "report_year"]).select("record_id", "lot_key", "choice")


@query("j8_cascade", _CHOICE + """, k as (select record_id, record_id % 4 as k from tokens)
select record_id, case when n = 1 and k < 3 then lot end as lot_key, case when k = 3 or n is null then 'no_match' when n > 1 then 'ambiguous' when k = 0 then 'exact' when k = 1 then 'core' else 'fuzzy' end as level
from k left join ch using (record_id)""")
def _j8(spark, sf):
    # a fourth of the tokens each: as the lot is written, in another order, with a wrong letter, and none
    t, k = _tokens(spark, sf), F.col("record_id") % 4
    typed = F.when(k == 0, F.col("exact")).when(k == 1, F.concat(F.regexp_extract("exact", "[0-9]+", 0), F.lit("ABDNR"))).when(k == 2, F.regexp_replace("exact", "D", "T")).otherwise("UNKNOWN")
    return L.cascade(t.withColumn("exact", typed).withColumn("core", P.core_key(typed)), _lots(spark, sf))


@query("j9_release_year", "select c_custkey, cast(2020 - ((2020 - cast(right(c_name, 1) as integer)) % 10) as integer) as year from customer")
def _j9(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.release_year(F.expr("cast(right(c_name, 1) as int)"), F.lit(2020), 10).alias("year"))


_STATUS = "with t as (select l_orderkey, l_linenumber, l_partkey, year(o_orderdate) as y, case when l_tax > 0.07 then null else year(l_shipdate) - l_linenumber + 1 end as r from lineitem join orders on l_orderkey = o_orderkey), s as (select *, case when r is null then 'not_assessable' when y < r then 'before_release' when y > r + 2 then 'expired' else 'valid' end as status from t)"


def _status(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = F.when(F.col("l_tax") > 0.07, None).otherwise(F.year("l_shipdate") - F.col("l_linenumber") + 1)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.year("o_orderdate").alias("y"), L.lot_status(F.year("o_orderdate"), r, 2).alias("status"))


@query("j10_lot_status", _STATUS + " select l_orderkey, l_linenumber, l_partkey, status from s")
def _j10(spark, sf):
    return _status(spark, sf).drop("y")


@query("j11_code_rules", "with r(rule, m) as (values ('last_digit', 10), ('last_two', 100)), t as (select year(o_orderdate) as y, o_orderkey % 100 as d from orders) select rule, round(avg(case when 2001 - ((2001 - d % m) % m + m) % m = y then 1.0 else 0.0 end), 6) as exact, round(avg(case when abs(2001 - ((2001 - d % m) % m + m) % m - y) <= 1 then 1.0 else 0.0 end), 6) as within_one from t cross join r group by 1")
def _j11(spark, sf):
    rules = spark.createDataFrame([("last_digit", 10), ("last_two", 100)], "rule string, m int")
    t = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 100).alias("d")).crossJoin(F.broadcast(rules))  # a declared list of rules
    year = 2001 - F.pmod(2001 - F.col("d") % F.col("m"), F.col("m"))
    return t.groupBy("rule").agg(F.round(F.avg((year == F.col("y")).cast("double")), 6).alias("exact"), F.round(F.avg((F.abs(year - F.col("y")) <= 1).cast("double")), 6).alias("within_one"))


@query("j12_validity_summary", _STATUS + " select cast(y as integer) as year, count(*) as n, count(*) filter (status = 'valid') as valid, count(*) filter (status = 'expired') as expired, round(100.0 * count(*) filter (status = 'valid') / count(*), 4) as pct_valid from s group by 1")
def _j12(spark, sf):
    s = F.col("status")
    return _status(spark, sf).groupBy(F.col("y").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "valid").alias("valid"), F.count_if(s == "expired").alias("expired"), F.round(100.0 * F.count_if(s == "valid") / F.count(F.lit(1)), 4).alias("pct_valid"))


@query("j13_linkage_bias", ctes("reports") + " select hospitalized as linked, count(*) as n, round(quantile_cont(len(vaccines), 0.5), 4) as median_products, round(100.0 * avg(cast(ev_urgent as int)), 4) as pct_urgent from reports group by 1")
def _j13(spark, sf):
    return V.reports(spark, sf).groupBy(F.col("hospitalized").alias("linked")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(F.size("vaccines"), F.lit(0.5)), 4).alias("median_products"), F.round(100.0 * F.avg(F.col("ev_urgent").cast("int")), 4).alias("pct_urgent"))


@query("j14_feasibility", _STATUS + ", a as (select count(*) filter (status in ('valid', 'expired')) as valid, count(*) filter (status = 'before_release') / count(*) as bad, count(distinct l_partkey) as lots from s) select valid, lots, round(bad, 6) as share, case when bad > 0.2 or valid < 200 or lots < 30 then 'insufficient' when bad > 0.1 then 'limited' else 'adequate' end as verdict from a")
def _j14(spark, sf):
    s = F.col("status")
    a = _status(spark, sf).agg(F.count_if(s.isin("valid", "expired")).alias("valid"), (F.count_if(s == "before_release") / F.count(F.lit(1))).alias("bad"), F.countDistinct("l_partkey").alias("lots"))
    verdict = F.when(F.expr("bad > 0.2 or valid < 200 or lots < 30"), "insufficient").when(F.col("bad") > 0.1, "limited").otherwise("adequate")
    return a.select("valid", "lots", F.round("bad", 6).alias("share"), verdict.alias("verdict"))


@query("j15_dimension_lookup", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, s_acctbal from lineitem join supplier on l_suppkey = s_suppkey")
def _j15(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_acctbal")
