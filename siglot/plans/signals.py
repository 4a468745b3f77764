"""Queries of disproportionality."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.operators import signals as G
from siglot.plans import views as V
from siglot.plans.registry import query
from siglot.plans.views import ctes

_COMP = ", ".join(f"'{x}'" for x in V.COMPARATORS)
_T = f"list_contains(vaccines, '{V.TARGET}')"
_MEMBERS = f"""members as (select record_id, 'others' as design, {_T} as target, analytic_year as year from reports
  union all select record_id, 'comparators', {_T}, analytic_year from reports where {_T} or len(list_intersect(vaccines, [{_COMP}])) > 0)"""
_CELLS = f"""{ctes('reports', 'event_long')}, {_MEMBERS},
x as (select design, event, count(*) filter (target and present) as a, count(*) filter (target and not present) as b, count(*) filter (not target and present) as c, count(*) filter (not target and not present) as d
  from members join event_long using (record_id) group by 1, 2),
cells as (select *, cast(a + b as double) * (a + c) / (a + b + c + d) as expected from x)"""
_H = "case when least(a, b, c, d) = 0 then 0.5 else 0 end"
_MEASURES = f"""{_CELLS}, y as (select *, ln(((a + {_H}) * (d + {_H})) / ((b + {_H}) * (c + {_H}))) as lr, sqrt(1 / (a + {_H}) + 1 / (b + {_H}) + 1 / (c + {_H}) + 1 / (d + {_H})) as sr,
 ln((a / (a + b)) / (c / (c + d))) as lp, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) as sp, cast(a + b + c + d as double) as n from cells),
m as (select *, exp(lr) as ror, exp(lr - 1.959963984540054 * sr) as ror_low, exp(lr + 1.959963984540054 * sr) as ror_high, exp(lp) as prr, exp(lp - 1.959963984540054 * sp) as prr_low, exp(lp + 1.959963984540054 * sp) as prr_high,
 n * pow(greatest(abs(cast(a as double) * d - cast(b as double) * c) - n / 2, 0), 2) / (cast(a + b as double) * (c + d) * (a + c) * (b + d)) as chi2, log2((a + 0.5) / (expected + 0.5)) as ic from y)"""


def members(spark, sf):
    """A row for each report, design and event, taken from the report's own row."""
    r = V.reports(spark, sf)
    target = F.array_contains("vaccines", V.TARGET)
    comparator = F.arrays_overlap("vaccines", F.array(*[F.lit(x) for x in V.COMPARATORS]))
    both = F.array(F.struct(F.lit("others").alias("design"), F.lit(True).alias("on")), F.struct(F.lit("comparators").alias("design"), (target | comparator).alias("on")))
    per_design = r.select("record_id", target.alias("target"), F.col("analytic_year").alias("year"), *V.EVENTS, F.explode(F.filter(both, lambda x: x["on"])).alias("x"))
    return G.with_events(per_design.select("record_id", "target", "year", F.col("x.design").alias("design"), *V.EVENTS), V.EVENTS)


def cells(spark, sf):
    return G.two_by_two_of(members(spark, sf))


def products(spark, sf):
    return G.product_event_counts_of(V.reports(spark, sf), "vaccines", V.EVENTS)


def r(c, digits=4):
    return F.round(c, digits)


@query("p1_two_by_two", _CELLS + " select design, event, a, b, c, d, round(expected, 4) as expected from cells")
def _p1(spark, sf):
    return cells(spark, sf).withColumn("expected", r("expected"))


@query("p2_ror", _MEASURES + " select design, event, round(ror, 4) as ror, round(ror_low, 4) as ror_low, round(ror_high, 4) as ror_high from m")
def _p2(spark, sf):
    return cells(spark, sf).select("design", "event", *[r(c).alias(k) for k, c in G.ror().items()])


@query("p3_prr", _MEASURES + " select design, event, round(prr, 4) as prr, round(prr_low, 4) as prr_low, round(prr_high, 4) as prr_high, round(chi2, 3) as chi2 from m")
def _p3(spark, sf):
    return cells(spark, sf).select("design", "event", *[r(c, 3 if k == "chi2" else 4).alias(k) for k, c in G.prr().items()])


@query("p4_information_component", _MEASURES + " select design, event, round(ic, 4) as ic from m")
def _p4(spark, sf):
    return cells(spark, sf).select("design", "event", r(G.information()["ic"]).alias("ic"))


@query("p4_ic_limits")
def _p4b(spark, sf):
    return cells(spark, sf).select("design", "event", *[c.alias(k) for k, c in G.information(limits=True).items()])


@query("p5_fisher_exact")
def _p5(spark, sf):
    return cells(spark, sf).withColumn("p", S.column(S.fisher_two_sided, "a", "b", "c", "d"))


@query("p6_benjamini_hochberg", _MEASURES + """, p as (select design, event, round(1 / (1 + chi2), 9) as p from m), k as (select *, count(*) over (partition by design) as m, row_number() over (partition by design order by p) as i from p)
select design, event, p, round(least(1, min(p * m / i) over (partition by design order by i desc)), 6) as p_adjusted from k
""")
def _p6(spark, sf):
    d = cells(spark, sf).select("design", "event", r(1 / (1 + G.prr()["chi2"]), 9).alias("p"))
    return G.fdr(d, "p", ["design"]).withColumn("p_adjusted", r("p_adjusted", 6))


@query("p7_product_event_counts", ctes("reports", "administrations", "event_long") + """,
h as (select vaccine, event, count(*) as n from administrations join event_long using (record_id) where present group by 1, 2),
g as (select v.vaccine, e.event, coalesce(n, 0) as n from (select distinct vaccine from administrations) v cross join (select distinct event from event_long) e left join h on h.vaccine = v.vaccine and h.event = e.event)
select vaccine, event, n, round(cast(sum(n) over (partition by vaccine) as double) * cast(sum(n) over (partition by event) as double) / cast(sum(n) over () as double), 4) as expected from g
""")
def _p7(spark, sf):
    return products(spark, sf).withColumn("expected", r("expected"))


@query("p8_p9_shrinkage")
def _p9(spark, sf):
    c = products(spark, sf)
    return G.shrunk(c, G.fit_prior(c))


@query("p8_prior")
def _p8(spark, sf):
    prior = G.fit_prior(products(spark, sf))
    return spark.createDataFrame([tuple(prior)], "a1 double, b1 double, a2 double, b2 double, weight double, converged boolean, log_likelihood double")


@query("p10_signal_criteria")
def _p10(spark, sf):
    prior = G.fit_prior(products(spark, sf))
    d = G.shrunk(cells(spark, sf).withColumnRenamed("a", "n"), prior).withColumnRenamed("n", "a").withColumns({**G.ror(), **G.prr(), **G.information(limits=True)})
    return d.select("design", "event", "a", *[c.alias(k) for k, c in G.criteria(shrunk=True).items()])


@query("p11_rethreshold", _MEASURES + " select design, event, a >= 100 and ror_low > 0.9 as signal_ror, a >= 100 and prr >= 1.01 and chi2 >= 0.5 as signal_prr, a >= 100 and ic > 0.01 as signal_ic from m")
def _p11(spark, sf):
    d = cells(spark, sf).withColumns({**G.ror(), **G.prr(), **G.information()})
    return d.select("design", "event", F.expr("a >= 100 and ror_low > 0.9").alias("signal_ror"), F.expr("a >= 100 and prr >= 1.01 and chi2 >= 0.5").alias("signal_prr"), F.expr("a >= 100 and ic > 0.01").alias("signal_ic"))


@query("p12_robust_signals", _MEASURES + " select event, bool_and(ic > 0) as robust, count(*) filter (ic > 0) as n_designs from m group by 1")
def _p12(spark, sf):
    d = cells(spark, sf).withColumns(G.information())
    return d.groupBy("event").agg(F.bool_and(F.col("ic") > 0).alias("robust"), F.count_if(F.col("ic") > 0).alias("n_designs"))


@query("p13_cumulative_ic", ctes("reports", "event_long") + ", " + _MEMBERS + """,
y as (select event, year, count(*) filter (target and present) as a, count(*) filter (target and not present) as b, count(*) filter (not target and present) as c, count(*) filter (not target and not present) as d from members join event_long using (record_id) where design = 'others' group by 1, 2),
z as (select event, year, cast(sum(a) over w as bigint) as a, cast(sum(b) over w as bigint) as b, cast(sum(c) over w as bigint) as c, cast(sum(d) over w as bigint) as d from y window w as (partition by event order by year rows unbounded preceding))
select event, year, a, b, c, d, round(log2((a + 0.5) / (cast(a + b as double) * (a + c) / (a + b + c + d) + 0.5)), 4) as ic from z
""")
def _p13(spark, sf):
    return G.cumulative_ic_of(members(spark, sf).where("design = 'others'")).withColumn("ic", r("ic"))


@query("p14_cooccurrence", ctes("reports", "event_long") + """, k as (select record_id, event from event_long where present), s as (select event, count(*) as n1 from k group by 1 having count(*) >= 0.01 * (select count(*) from reports)),
p as (select l.event as x, r.event as y, count(*) as n11 from k l join k r on l.record_id = r.record_id and l.event < r.event group by 1, 2)
select x, y, n11, round(ln((n11 + 0.5) * ((select count(*) from reports) - a.n1 - b.n1 + n11 + 0.5) / ((a.n1 - n11 + 0.5) * (b.n1 - n11 + 0.5))), 4) as log_or from p join s a on a.event = x join s b on b.event = y
""")
def _p14(spark, sf):
    return G.cooccurrence(V.event_long(spark, sf)).withColumn("log_or", r("log_or"))


@query("p15_signals_per_design", _MEASURES + " select design, count(*) as screened, count(*) filter (a >= 3 and ic > 0) as primary_signals, count(*) filter (ic > 0 or ror_low > 1) as any_signal from m group by 1")
def _p15(spark, sf):
    d = cells(spark, sf).withColumns({**G.ror(), **G.information()})
    return d.groupBy("design").agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.expr("a >= 3 and ic > 0")).alias("primary_signals"), F.count_if(F.expr("ic > 0 or ror_low > 1")).alias("any_signal"))
