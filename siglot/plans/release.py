"""Queries of disclosure control, and of incremental deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import disclosure as X
from siglot.plans.registry import query
from siglot.plans.views import table
from siglot.sources import files
from siglot.streaming import deliveries

# cells of a supplier and a month hold some seven rows at every scale, so that small ones occur without leaving rows out
_N = "with c as (select l_suppkey, cast(year(l_shipdate) * 100 + month(l_shipdate) as integer) as month, count(*) as n, round(avg(l_quantity), 4) as mean from lineitem group by 1, 2)"


def _month():
    return (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month")


def _counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", _month()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("x1_suppress_counts", _N + " select l_suppkey, month, case when n between 1 and 4 then null else n end as n, case when n between 1 and 4 then 'primary' else 'visible' end as n_status, case when n between 1 and 4 then null else mean end as mean from c")
def _x1(spark, sf):
    return X.suppress(_counts(spark, sf), {"n": ["mean"]})


@query("x2_suppress_linked", _N + " select l_suppkey, month, n, case when n between 1 and 4 then null else mean end as mean from c")
def _x2(spark, sf):
    return X.suppress_linked(_counts(spark, sf), "n", ["mean"])


@query("x3_x4_cross_secondary")
def _x3(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return X.suppress_cross(d, ["l_suppkey"], "l_returnflag", "year", "n")


@query("x5_column_secondary", _N + """, s as (select *, case when n between 1 and 4 then 'primary' else 'visible' end as status from c),
w as (select *, count(*) filter (status <> 'visible') over (partition by l_suppkey) as h, row_number() over (partition by l_suppkey order by case when status = 'visible' and n > 0 then 0 else 1 end, n, month) as k from s)
select l_suppkey, month, n, case when h = 1 and k = 1 and status = 'visible' and n > 0 then 'secondary' else status end as status from w
""")
def _x5(spark, sf):
    d = _counts(spark, sf).drop("mean").withColumn("status", F.when(X.small(F.col("n")), "primary").otherwise("visible"))
    return X.suppress_secondary(d, ["l_suppkey"], "n")


@query("x6_implied_percentage", "with c as (select l_suppkey, count(*) as n, round(100.0 * count(*) filter (l_quantity = 50 and l_tax = 0) / count(*), 1) as pct from lineitem group by 1) select l_suppkey, n, case when round_even(n * pct / 100, 0) between 1 and 4 or n - round_even(n * pct / 100, 0) between 1 and 4 then null else pct end as pct from c")
def _x6(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l_quantity = 50 and l_tax = 0")).alias("k"))
    return d.withColumn("pct", F.round(100.0 * F.col("k") / F.col("n"), 1)).select("l_suppkey", "n", X.implied(F.col("n"), F.col("pct")).alias("pct"))


_DES = "with x as (select case when l_linenumber = 7 and l_tax = 0.08 then 'wide' else 'main' end as k, l_returnflag as event, l_linestatus, l_quantity from lineitem), m as (select 'main' as design, event, count(*) filter (l_linestatus = 'O' and l_quantity > 25) as a, count(*) filter (l_linestatus = 'O' and l_quantity <= 25) as b, count(*) filter (l_linestatus = 'F' and l_quantity > 25) as c, count(*) filter (l_linestatus = 'F' and l_quantity <= 25) as d from x where k = 'main' group by 2 union all select 'wide', event, count(*) filter (l_linestatus = 'O' and l_quantity > 25), count(*) filter (l_linestatus = 'O' and l_quantity <= 25), count(*) filter (l_linestatus = 'F' and l_quantity > 25), count(*) filter (l_linestatus = 'F' and l_quantity <= 25) from x group by 2)"


def _designs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("event", F.col("l_returnflag"))
    o, q = F.col("l_linestatus") == "O", F.col("l_quantity") > 25
    f = lambda d, name: d.groupBy("event").agg(F.count_if(o & q).alias("a"), F.count_if(o & ~q).alias("b"), F.count_if(~o & q).alias("c"), F.count_if(~o & ~q).alias("d")).withColumn("design", F.lit(name))
    return f(li.where("not (l_linenumber = 7 and l_tax = 0.08)"), "main").unionByName(f(li, "wide"))


@query("x7_nested_designs", _DES + " select m.design, m.event, m.a, m.b, m.c, m.d, m.design <> 'main' and (abs(m.a - p.a) between 1 and 4 or abs(m.b - p.b) between 1 and 4 or abs(m.c - p.c) between 1 and 4 or abs(m.d - p.d) between 1 and 4) as withheld from m join (select * from m where design = 'main') p on p.event = m.event")
def _x7(spark, sf):
    return X.nested_designs(_designs(spark, sf), "main")


_CUM = "c as (select l_suppkey, cast(year(l_shipdate) * 100 + month(l_shipdate) as integer) as month, count(*) as k from lineitem group by 1, 2), s as (select l_suppkey, month, cast(sum(k) over (partition by l_suppkey order by month) as bigint) as n, row_number() over (partition by l_suppkey order by month) as i from c)"


@query("x8_cumulative", f"with recursive {_CUM}, r as (select l_suppkey, month, n, i, not n between 1 and 4 as released, case when n between 1 and 4 then 0 else n end as last from s where i = 1 union all select s.l_suppkey, s.month, s.n, s.i, not s.n - r.last between 1 and 4, case when s.n - r.last between 1 and 4 then r.last else s.n end from s join r on s.l_suppkey = r.l_suppkey and s.i = r.i + 1) select l_suppkey, month, n, released from r")
def _x8(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "lineitem").groupBy("l_suppkey", _month()).agg(F.count(F.lit(1)).alias("k"))
    d = d.select("l_suppkey", "month", F.sum("k").over(Window.partitionBy("l_suppkey").orderBy("month")).alias("n"))
    return X.cumulative(d, "l_suppkey", "month", "n")


@query("x9_complement", "select l_suppkey, count(*) as total, count(*) filter (l_quantity < 49) as part, not (count(*) - count(*) filter (l_quantity < 49) between 1 and 4) and not (count(*) filter (l_quantity < 49) between 1 and 4) as shown from lineitem group by 1")
def _x9(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_quantity") < 49).alias("part"))
    return d.withColumn("shown", X.complement(F.col("total"), F.col("part")))


@query("x10_design_sizes", _DES + " select design, max(a + b) as target, max(c + d) as comparator from m group by 1")
def _x10(spark, sf):
    return _designs(spark, sf).groupBy("design").agg(F.max(F.col("a") + F.col("b")).alias("target"), F.max(F.col("c") + F.col("d")).alias("comparator"))


@query("x12_suppression_log", _N + " select 'counts' as \"table\", 'primary' as kind, count(*) as n from c where n between 1 and 4 having count(*) > 0")
def _x12(spark, sf):
    return X.log_table(X.suppress(_counts(spark, sf), {"n": ["mean"]}), "counts", "n_status")


@query("x13_violations", "select 'forbidden_column' as rule, 'c_name' as \"column\", count(*) as n from customer union all select 'digits', 'c_name', count(*) from customer where regexp_matches(c_name, '[0-9]{6}') having count(*) > 0 union all select 'small_count', 'c_nationkey', count(*) from customer where c_nationkey between 1 and 4 having count(*) > 0")
def _x13(spark, sf):
    return X.violations(table(spark, sf, "customer"), ["c_name"], {"digits": "[0-9]{6}"}, ["c_nationkey"])


@query("x15_safe_totals", _N + " select l_suppkey, case when bool_and(n >= 5) then cast(sum(n) as bigint) end as total from c group by 1")
def _x15(spark, sf):
    d = _counts(spark, sf).withColumn("visible", ~X.small(F.col("n")))
    return X.safe_total(d, ["l_suppkey"], "n", "visible")


@query("w1_incremental_ingest", "select event_id, cast(epoch_us(ts) as bigint) as at, user_id, event_type, value from events")
def _w1(spark, sf):
    out = deliveries.ingest(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, ["event_id"])
    return out.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type", "value")


@query("w2_streaming_counts", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n from events group by 1, 2")
def _w2(spark, sf):
    return deliveries.daily_counts(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


@query("w1_superseded_deliveries", """
select cast(event_id as bigint) as event_id, cast(month(ts) as integer) as period, case when month(ts) % 2 = 0 then 2 else 1 end as delivered, round(case when month(ts) % 2 = 0 then value * 2 else value end, 6) as value
from events where month(ts) % 2 = 1 or event_id % 3 <> 0
""")
def _w1b(spark, sf):
    """Even months are delivered twice: the second, cumulative file has corrected values and lacks every third event, and comes before the first one's copy that is late."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.month("ts").alias("period"), "value")
    at = files.scratch(spark)
    first = e.withColumn("delivered", F.lit(1))
    second = e.where("period % 2 = 0 and event_id % 3 <> 0").withColumns({"delivered": F.lit(2), "value": F.col("value") * 2})
    parts = -(-max(1, e.count()) // deliveries.MOST_ROWS)  # files of a delivery, which make a batch
    for k, part in enumerate((first, second, first.where("period % 2 = 0"))):
        part.repartition(parts).write.parquet(f"{at}/delivery={k}")
    out = deliveries.ingest_versions(spark, at, first.schema, ["event_id"], "period", "delivered", files=parts)
    return out.select("event_id", "period", "delivered", F.round("value", 6).alias("value"))
