"""Queries of process quality: capability, control charts, multivariate and equivalence statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import measures as M
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes, table

_ORD = ", ".join(V.QC_ORDER) + ", l_extendedprice"


@query("q1_q3_transform_to_window", "select l_orderkey, l_linenumber, l_partkey, round(case when l_quantity > 0 then log10(l_quantity) end, 6) as t, round((log10(l_quantity) - log10(1)) / (log10(50) - log10(1)), 6) as w from lineitem")
def _q1(spark, sf):
    t = F.when(F.col("l_quantity") > 0, F.log10("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(t, 6).alias("t"), F.round(t / F.log10(F.lit(50.0)), 6).alias("w"))


@query("q2_attribute_scales", ctes("qc") + " select series, min(l_tax) as window_low, case when max(l_tax) <= min(l_tax) then min(l_tax) + 1 else max(l_tax) end as window_high from qc group by 1")
def _q2(spark, sf):
    lo, hi = F.min("l_tax"), F.max("l_tax")
    return V.qc(spark, sf).groupBy("series").agg(lo.alias("window_low"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("window_high"))


@query("q4_capability", ctes("qc") + """ select series, count(*) as n, round(avg(l_extendedprice), 2) as mean, round(stddev_samp(l_extendedprice), 2) as sd, round(least((avg(l_extendedprice) - 1000) / (3 * stddev_samp(l_extendedprice)), (90000 - avg(l_extendedprice)) / (3 * stddev_samp(l_extendedprice))), 4) as ppk,
  round(100.0 * count(*) filter (l_extendedprice >= 1000 and l_extendedprice <= 90000) / count(*), 4) as pct_conforming from qc group by 1""")
def _q4(spark, sf):
    d = M.capability(V.qc(spark, sf), "series", "l_extendedprice", F.lit(1000), F.lit(90000))
    return d.select("series", "n", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), F.round("ppk", 4).alias("ppk"), F.round("pct_conforming", 4).alias("pct_conforming"))


@query("q5_percentile_ppk", ctes("qc") + ", q as (select series, quantile_cont(l_extendedprice, 0.00135) as a, quantile_cont(l_extendedprice, 0.5) as b, quantile_cont(l_extendedprice, 0.99865) as c, count(*) as n from qc group by 1) select series, round(case when n >= 50 then least((b - 1000) / (b - a), (90000 - b) / (c - b)) end, 4) as ppk from q")
def _q5(spark, sf):
    q = M.quantiles(V.qc(spark, sf), "series", "l_extendedprice", [0.00135, 0.5, 0.99865])
    a, b, c = (F.get("q", F.lit(i)) for i in range(3))
    return q.select("series", F.round(F.when(F.col("n") >= 50, F.least((b - 1000) / (b - a), (90000 - b) / (c - b))), 4).alias("ppk"))


_IND = ctes("qc") + f""", o as (select *, row_number() over (partition by series order by {_ORD}) as i, abs(l_quantity - lag(l_quantity) over (partition by series order by {_ORD})) as mr from qc),
lim as (select series, avg(l_quantity) as centre, avg(mr) / 1.128 as sigma from o group by 1), z as (select o.*, centre, sigma, (l_quantity - centre) / sigma as z from o join lim using (series))"""


def _individuals(spark, sf):
    d = V.qc(spark, sf).select("series", *V.QC_ORDER, "l_extendedprice")
    return M.individuals(d, "series", [*V.QC_ORDER, "l_extendedprice"], "l_quantity").select("series", "i", "l_quantity", "centre", "sigma", "z")


@query("q8_individuals", _IND + " select series, cast(i as integer) as i, l_quantity, round(centre, 4) as centre, round(sigma, 4) as sigma, round(z, 4) as z from z")
def _q8(spark, sf):
    return _individuals(spark, sf).select("series", "i", "l_quantity", *[F.round(c, 4).alias(c) for c in ("centre", "sigma", "z")])


_NELSON = _IND + """, d as (select series, i, round(z, 6) as v, sign(round(z, 6) - lag(round(z, 6)) over (partition by series order by i)) as d from z),
rules as (select series, i, abs(v) > 3 as rule1,
 sum(case when v > 0 then 1 else 0 end) over n9 >= 9 or sum(case when v < 0 then 1 else 0 end) over n9 >= 9 as rule2,
 sum(case when d > 0 then 1 else 0 end) over n5 >= 5 or sum(case when d < 0 then 1 else 0 end) over n5 >= 5 as rule3,
 (sum(case when v > 2 then 1 else 0 end) over n3 >= 2 or sum(case when v < -2 then 1 else 0 end) over n3 >= 2) and i >= 3 as rule5
 from d window n9 as (partition by series order by i rows between 8 preceding and current row), n5 as (partition by series order by i rows between 4 preceding and current row), n3 as (partition by series order by i rows between 2 preceding and current row))"""


@query("q9_nelson_rules", _NELSON + " select series, cast(i as integer) as i, rule1, rule2, rule3, rule5 from rules")
def _q9(spark, sf):
    return M.nelson(_individuals(spark, sf).withColumn("z", F.round("z", 6)), "series").select("series", "i", "rule1", "rule2", "rule3", "rule5")


@query("q10_ewma", _IND + """, e as (select a.series, a.i, sum(0.2 * pow(0.8, a.i - b.i) * b.z) as ewma from z a join z b on a.series = b.series and b.i between a.i - 170 and a.i group by 1, 2)
select series, cast(i as integer) as i, round(ewma, 4) + 0.0 as ewma, round(3 * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * i))), 6) as "limit" from e""")
def _q10(spark, sf):
    return M.ewma(_individuals(spark, sf), "series").select("series", "i", (F.round("ewma", 4) + 0.0).alias("ewma"), F.round("limit", 6).alias("limit"))


@query("q11_spc_change_points")
def _q11(spark, sf):
    weekly = V.qc(spark, sf).groupBy("series", F.date_trunc("week", "l_shipdate").alias("week")).agg(F.avg("l_quantity").alias("y"))
    return M.change_points(weekly, "series", "week", "y")


@query("q12_chart_summary", _NELSON + " select series, count(*) filter (rule1) as rule1, count(*) filter (rule2) as rule2, count(*) filter (rule3) as rule3, count(*) filter (rule5) as rule5 from rules group by 1")
def _q12(spark, sf):
    d = M.nelson(_individuals(spark, sf).withColumn("z", F.round("z", 6)), "series")
    return d.groupBy("series").agg(*[F.count_if(r).alias(r) for r in ("rule1", "rule2", "rule3", "rule5")])


@query("q14_scores_fixed_loadings", "select vec_id, round(0.5 * cast(embedding[1] as double) + 0.5 * cast(embedding[2] as double) - 0.5 * cast(embedding[3] as double) - 0.5 * cast(embedding[4] as double), 5) as score, round(pow(0.5 * cast(embedding[1] as double) + 0.5 * cast(embedding[2] as double) - 0.5 * cast(embedding[3] as double) - 0.5 * cast(embedding[4] as double), 2) / 1.5, 5) as t2 from embeddings")
def _q14(spark, sf):
    loadings = F.array(*[F.lit(x) for x in (0.5, 0.5, -0.5, -0.5)])
    score = F.aggregate(F.zip_with(F.slice("embedding", 1, 4), loadings, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(score, 5).alias("score"), F.round(score * score / 1.5, 5).alias("t2"))


def _monitor(spark, sf, robust):
    from siglot.operators.monitoring import fit_monitor

    rows = table(spark, sf, "lineitem")
    return rows, fit_monitor(rows, V.ATTRIBUTES, robust=robust)


@query("q13_q15_robust_monitor")
def _q13(spark, sf):
    m = _monitor(spark, sf, True)[1]
    rows = [(c, float(m.mean[i]), float(m.scale[i]), float(m.values[i]), m.a, m.t2_limit, m.spe_limit) for i, c in enumerate(m.columns)]
    return spark.createDataFrame(rows, "attribute string, centre double, scale double, eigenvalue double, components int, t2_limit double, spe_limit double")


@query("q14_t2_spe")
def _q14b(spark, sf):
    rows, m = _monitor(spark, sf, True)
    d = m.scores(rows)
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("t2_flag").alias("t2_flagged"), F.count_if("spe_flag").alias("spe_flagged"), F.round(F.avg("t2"), 4).alias("mean_t2"), F.round(F.avg("spe"), 4).alias("mean_spe"))


@query("q16_t2_contributions")
def _q16b(spark, sf):
    rows, m = _monitor(spark, sf, True)
    top = F.posexplode("contributions").alias("i", "c")
    d = m.scores(rows).select("t2_flag", top).withColumn("attribute", F.get(F.array(*[F.lit(c) for c in m.columns]), F.col("i")))
    return d.groupBy("t2_flag", "attribute").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 4).alias("mean_contribution"))


@query("q16_atypicality", "with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() over (partition by l_suppkey order by l_extendedprice) + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2.0 as k, count(*) over (partition by l_suppkey) as n from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, k as avg_rank, n from r")
def _q16(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "lineitem").withColumns({"k": M.average_rank(F.col("l_extendedprice"), "l_suppkey"), "n": F.count(F.lit(1)).over(Window.partitionBy("l_suppkey"))})
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("k").alias("avg_rank"), "n")


@query("q17_top_contributors", "with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, unnest(['quantity', 'discount', 'tax']) as attribute, unnest([abs(l_quantity - 25) / 15, abs(l_discount - 0.05) / 0.03, abs(l_tax - 0.04) / 0.025]) as v from lineitem), r as (select attribute, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice order by round(v, 9) desc, attribute) as k from c) select attribute, count(*) as n from r where k <= 2 group by 1")
def _q17(spark, sf):
    from pyspark.sql import Window

    parts = {"quantity": F.abs(F.col("l_quantity") - 25) / 15, "discount": F.abs(F.col("l_discount") - 0.05) / 0.03, "tax": F.abs(F.col("l_tax") - 0.04) / 0.025}
    rows = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.round(v, 9).alias("v")) for k, v in parts.items()])).alias("c")).select(*keys, "c.*")
    w = Window.partitionBy(*keys).orderBy(F.desc("v"), "attribute")
    return long.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


@query("q18_tost_welch")
def _q18(spark, sf):
    return M.tost(table(spark, sf, "lineitem"), F.col("l_linestatus") == "O", "l_quantity", 1.0)


@query("q18_welch_parts", "with a as (select avg(l_quantity) filter (l_linestatus = 'O') as m1, avg(l_quantity) filter (l_linestatus <> 'O') as m2, var_samp(l_quantity) filter (l_linestatus = 'O') / count(*) filter (l_linestatus = 'O') as v1, var_samp(l_quantity) filter (l_linestatus <> 'O') / count(*) filter (l_linestatus <> 'O') as v2, count(*) filter (l_linestatus = 'O') as n1, count(*) filter (l_linestatus <> 'O') as n2 from lineitem) select round(m1 - m2, 6) as diff, round(sqrt(v1 + v2), 6) as se, round(pow(v1 + v2, 2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)), 2) as df from a")
def _q18b(spark, sf):
    d = M.tost(table(spark, sf, "lineitem"), F.col("l_linestatus") == "O", "l_quantity", 1.0)
    return d.select(F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("df", 2).alias("df"))


@query("q20_energy_statistic", """
with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null), p as (select a.label as x, b.label as y, sum(list_distance(a.e, b.e)) as d from v a join v b on a.vec_id < b.vec_id group by 1, 2),
c as (select label, cast(count(*) as double) as n, (select count(*) from v) - count(*) as m from v group by 1),
s as (select label, n, cast(m as double) as m, (select sum(d) from p where (x = label) <> (y = label)) as ab, (select sum(d) from p where x = label and y = label) as aa, (select sum(d) from p where x <> label and y <> label) as bb from c)
select label, cast(n as bigint) as n, cast(m as bigint) as m, round(n * m / (n + m) * (2 * ab / (n * m) - 2 * coalesce(aa, 0) / (n * n) - 2 * coalesce(bb, 0) / (m * m)), 4) as energy from s
""")
def _q20(spark, sf):
    return M.energy_tests(table(spark, sf, "embeddings"), "embedding", "label", permutations=0).select("label", "n", "m", F.round("energy", 4).alias("energy"))


@query("q20_energy_permutations")
def _q20b(spark, sf):
    return M.energy_tests(table(spark, sf, "embeddings"), "embedding", "label", permutations=199)


@query("q7_capability_periods", ctes("qc") + ", p as (select *, case when year(l_shipdate) < 1998 then 'before' else 'during' end as period from qc) select period, series, count(*) as n, round(least((avg(l_extendedprice) - 1000) / (3 * stddev_samp(l_extendedprice)), (90000 - avg(l_extendedprice)) / (3 * stddev_samp(l_extendedprice))), 4) as ppk from p group by 1, 2")
def _q7(spark, sf):
    d = V.qc(spark, sf).withColumn("period", F.when(F.year("l_shipdate") < 1998, "before").otherwise("during")).withColumn("at", F.concat_ws("|", "period", "series"))
    c = M.capability(d, "at", "l_extendedprice", F.lit(1000), F.lit(90000))
    return c.select(F.split("at", r"\|")[0].alias("period"), F.split("at", r"\|")[1].alias("series"), "n", F.round("ppk", 4).alias("ppk"))


@query("q21_destination_split", "select l_linestatus = 'O' as national, count(*) as n, round(avg(l_quantity), 6) as mean, round(quantile_cont((l_quantity - 1) / 49, 0.5), 6) as median_window from lineitem group by 1")
def _q21(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_linestatus") == "O").alias("national")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.percentile((F.col("l_quantity") - 1) / 49, F.lit(0.5)), 6).alias("median_window"))


@query("q8_q10_gaps", ctes("qc") + f""", o as (select *, case when l_linenumber = 5 then null else l_quantity end as q, row_number() over (partition by series order by {_ORD}) as i from qc),
k as (select *, count(q) over (partition by series order by i) as j from o), kn as (select series, j, q, abs(q - lag(q) over (partition by series order by j)) as mr from k where q is not null),
lim as (select series, avg(q) as c, avg(mr) / 1.128 as s from kn group by 1), z as (select kn.series, j, (q - c) / s as z from kn join lim using (series)),
e as (select a.series, a.j, sum(0.2 * pow(0.8, a.j - b.j) * b.z) as ewma from z a join z b on a.series = b.series and b.j between a.j - 135 and a.j group by 1, 2)
select k.series, cast(i as integer) as i, round(s, 4) as sigma, round(case when q is not null then (q - c) / s end, 4) + 0.0 as z, round(coalesce(ewma, 0), 4) + 0.0 as ewma from k join lim using (series) left join e on e.series = k.series and e.j = k.j""")
def _q8b(spark, sf):
    d = V.qc(spark, sf).select("series", *V.QC_ORDER, "l_extendedprice", F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("q"))
    out = M.ewma(M.individuals(d, "series", [*V.QC_ORDER, "l_extendedprice"], "q").select("series", "i", "sigma", "z"), "series")
    return out.select("series", "i", F.round("sigma", 4).alias("sigma"), (F.round("z", 4) + 0.0).alias("z"), (F.round("ewma", 4) + 0.0).alias("ewma"))
