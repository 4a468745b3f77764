"""Queries of descriptive tables, rates, time series and change points."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import measures as M
from siglot.operators.counts import count_models, interrupted
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.tables import _MONTHS, _coverage
from siglot.plans.views import ctes, table


@query("a1_characteristics", """
with u as (select 'status' as variable, o_orderstatus as level, o_orderpriority as grp from orders union all select 'year', cast(year(o_orderdate) as varchar), o_orderpriority from orders),
n as (select variable, level, grp, count(*) as n from u group by 1, 2, 3 union all select variable, level, 'All', count(*) from u group by 1, 2)
select variable, level, grp, n, cast(sum(n) over (partition by variable, grp) as bigint) as denominator, round(100.0 * n / cast(sum(n) over (partition by variable, grp) as double), 4) as pct from n
""")
def _a1(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    return M.characteristics(df, ["status", "year"], "o_orderpriority")


_Q = "round(quantile_cont({v}, 0.25), 4) as q1, round(quantile_cont({v}, 0.5), 4) as median, round(quantile_cont({v}, 0.75), 4) as q3, round(quantile_cont({v}, 0.9), 4) as p90"


@query("a2_a5_summary", f"select l_returnflag, count(*) as n, round(avg(l_quantity), 4) as mean, round(stddev_samp(l_quantity), 4) as sd, min(l_quantity) as min, {_Q.format(v='l_quantity')}, max(l_quantity) as max from lineitem group by 1")
def _a2(spark, sf):
    return M.summary(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("a3_event_frequency", ctes("reports", "event_long") + " select event, hospitalized, count(*) filter (present) as n_true, count(present) as n_known from event_long join reports using (record_id) group by 1, 2")
def _a3(spark, sf):
    d = V.event_long(spark, sf).join(V.reports(spark, sf).select("record_id", "hospitalized"), "record_id")
    return d.groupBy("event", "hospitalized").agg(F.count_if("present").alias("n_true"), F.count("present").alias("n_known"))


@query("a4_reports_by_year", ctes("reports") + f" select analytic_year, count(*) as n, count(*) filter (list_contains(vaccines, '{V.TARGET}')) as target, count(*) filter (hospitalized) as hospitalized from reports group by 1")
def _a4(spark, sf):
    return V.reports(spark, sf).groupBy("analytic_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("vaccines", V.TARGET)).alias("target"), F.count_if("hospitalized").alias("hospitalized"))


@query("a6_crosstab_chi2", """
with n as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2), t as (select sum(n) as t from n), r as (select a, sum(n) as r from n group by 1), c as (select b, sum(n) as c from n group by 1),
g as (select a, b, coalesce(n, 0) as n, cast(r as double) * c / t as e from r cross join c cross join t left join n using (a, b))
select round(sum(pow(n - e, 2) / e), 2) as chi2, cast((count(distinct a) - 1) * (count(distinct b) - 1) as bigint) as dof from g
""")
def _a6(spark, sf):
    return M.crosstab_chi2(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("chi2", F.round("chi2", 2))


@query("a7_annual_quantiles", ctes("qc") + """, u as (select cast(year(l_shipdate) as integer) as year, 'l_quantity' as attribute, l_quantity as v from qc union all select year(l_shipdate), 'l_tax', l_tax from qc)
select year, attribute, count(*) as n, case when count(*) >= 5 then round(quantile_cont(v, 0.1), 4) end as q10, case when count(*) >= 5 then round(quantile_cont(v, 0.5), 4) end as q50, case when count(*) >= 5 then round(quantile_cont(v, 0.9), 4) end as q90 from u group by 1, 2
""")
def _a7(spark, sf):
    u = V.qc(spark, sf).select(F.year("l_shipdate").alias("year"), "l_quantity", "l_tax").unpivot(["year"], ["l_quantity", "l_tax"], "attribute", "v")
    d = M.quantiles(u.select(F.struct("year", "attribute").alias("at"), "v"), "at", "v", [0.1, 0.5, 0.9])
    return d.select("at.*", "n", *[F.when(F.col("n") >= 5, F.round(F.get("q", F.lit(i)), 4)).alias(c) for i, c in enumerate(("q10", "q50", "q90"))])


@query("a8_spearman", """
with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from lineitem)
select l_returnflag, round(corr(a, b), 6) as rho from r group by 1
""")
def _a8(spark, sf):
    return M.spearman(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("a9_value_counts", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as n_suppliers from lineitem group by 1, 2")
def _a9(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("a10_pivot", "select l_suppkey, count(*) filter (l_returnflag = 'A') as \"A\", count(*) filter (l_returnflag = 'N') as \"N\", count(*) filter (l_returnflag = 'R') as \"R\" from lineitem group by 1")
def _a10(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("a11_set_operations", "select l_suppkey, 'both' as side from (select l_suppkey from lineitem where l_returnflag = 'A' intersect select l_suppkey from lineitem where l_tax = 0.08) union all select s_suppkey, 'unused' from (select s_suppkey from supplier except select l_suppkey from lineitem where l_discount = 0.1 and l_quantity = 50)")
def _a11(spark, sf):
    li = table(spark, sf, "lineitem")
    both = li.where("l_returnflag = 'A'").select("l_suppkey").intersect(li.where("l_tax = 0.08").select("l_suppkey")).withColumn("side", F.lit("both"))
    unused = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).subtract(li.where("l_discount = 0.1 and l_quantity = 50").select("l_suppkey")).withColumn("side", F.lit("unused"))
    return both.unionByName(unused)


@query("a13_top_per_group", "select p_brand, p_partkey, place from (select p_brand, p_partkey, cast(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as integer) as place from part) where place <= 4")
def _a13(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place")).where("place <= 4")


@query("a14_headline", ctes("reports") + " select count(*) as reports, min(analytic_year) as first_year, max(analytic_year) as last_year, count(*) filter (hospitalized) as hospitalized, round(avg(len(vaccines)), 4) as mean_products from reports")
def _a14(spark, sf):
    return V.reports(spark, sf).agg(F.count(F.lit(1)).alias("reports"), F.min("analytic_year").alias("first_year"), F.max("analytic_year").alias("last_year"), F.count_if("hospitalized").alias("hospitalized"), F.round(F.avg(F.size("vaccines")), 4).alias("mean_products"))


_RATES = _MONTHS + """, n as (select year(l_shipdate) as year, count(*) as n, sum(l_quantity) as doses from lineitem where l_returnflag = 'R' group by 1), partial as (select year from f group by 1 having count(*) filter (observed) < 12)"""


def _rates(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("doses"))
    from siglot.operators.curation import partial_years

    return M.reporting_rates(li.select("year", "n"), li.select("year", "doses"), "year", partial_years(_coverage(spark, sf), "year"))


@query("t1_reporting_rates", _RATES + " select cast(n.year as integer) as year, n, doses, round(case when p.year is null then n / doses * 100000 end, 4) as rate from n left join partial p using (year)")
def _t1(spark, sf):
    return _rates(spark, sf).withColumn("rate", F.round("rate", 4))


@query("t2_garwood_ci")
def _t2(spark, sf):
    low, high = M.garwood(F.col("n"))
    return _rates(spark, sf).select("year", "n", low.alias("low"), high.alias("high"))


@query("t3_wilson_ci", """
with k as (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as k from lineitem group by 1), p as (select *, k / n as p, pow(1.959963984540054, 2) as z2 from k)
select l_suppkey, k, n, round((p + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 4) as low, round((p + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 4) as high from p
""")
def _t3(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return d.select("l_suppkey", "k", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("t4_rate_trend")
def _t4(spark, sf):
    return spark.createDataFrame([M.poisson_trend(_rates(spark, sf).where("rate is not null"), "year", "n", "doses")])


@query("t6_monthly_series", """
with n as (select cast(date_trunc('month', l_shipdate) as date) as m, count(*) as n from lineitem group by 1), g as (select cast(unnest(generate_series((select min(m) from n), (select max(m) from n), interval 1 month)) as date) as m)
select cast(g.m as varchar) as month, coalesce(n, 0) as n from g left join n using (m)
""")
def _t6(spark, sf):
    return M.monthly_series(table(spark, sf, "lineitem"), "l_shipdate").withColumn("month", F.col("month").cast("string"))


@query("t7_t8_change_points")
def _t8(spark, sf):
    monthly = table(spark, sf, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg((2 * F.sqrt(F.count(F.lit(1)) + 3 / 8)).alias("y"))
    return M.change_points(monthly, "l_suppkey", "month", "y", least=6)


@query("t8_best_split", ctes("qc") + """, w as (select series, cast(l_quantity as double) as v, row_number() over (partition by series order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k, count(*) over (partition by series) as n, sum(l_quantity) over (partition by series) as t,
 sum(l_quantity) over (partition by series order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice rows unbounded preceding) as s from qc), g as (select series, k, round(s * s / k + pow(t - s, 2) / (n - k) - t * t / n, 4) as gain from w where k < n)
select series, arg_max(k, row(gain, -k)) as n_before, max(gain) as gain from g group by 1
""")
def _t8b(spark, sf):
    return M.best_split(V.qc(spark, sf), ["series"], [*V.QC_ORDER, "l_extendedprice"], "l_quantity")


@query("t9_interrupted_means", "select count(*) filter (year(o_orderdate) < 1998) as pre_n, round(avg(o_totalprice) filter (year(o_orderdate) < 1998), 2) as pre_mean, count(*) filter (year(o_orderdate) >= 1998) as post_n, round(avg(o_totalprice) filter (year(o_orderdate) >= 1998), 2) as post_mean from orders")
def _t9(spark, sf):
    before = F.year("o_orderdate") < 1998
    v = lambda c: F.when(c, F.col("o_totalprice"))
    return table(spark, sf, "orders").agg(F.count_if(before).alias("pre_n"), F.round(F.avg(v(before)), 2).alias("pre_mean"), F.count_if(~before).alias("post_n"), F.round(F.avg(v(~before)), 2).alias("post_mean"))


def _yearly(spark, sf):
    """Reports and lines of each product and year."""
    d = V.reports(spark, sf).select(F.explode("vaccines").alias("product"), F.col("analytic_year").alias("year"), "ev_returned")
    return d.groupBy("product", "year").agg(F.count_if("ev_returned").alias("n"), F.count(F.lit(1)).cast("double").alias("doses"))


@query("t5_negative_binomial_trend")
def _t5(spark, sf):
    return count_models(_yearly(spark, sf), "product", "n", {"year": F.col("year") - 1995}, "doses")


@query("t9_interrupted_series")
def _t9b(spark, sf):
    monthly = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"))
    d = monthly.withColumns({"t": F.col("year") * 12 + F.col("month"), "every": F.lit("urgent")})
    return count_models(d, "every", "n", interrupted(F.col("t"), 1995 * 12 + 1, 1995 * 12 + 6))
