"""The roles that the given tables play: reports, administrations, events, lots. Each view exists for Spark and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "Brand#13"
COMPARATORS = ["Brand#21", "Brand#22", "Brand#23", "Brand#24", "Brand#25"]
EVENTS = ["ev_returned", "ev_urgent", "ev_bulk", "ev_open", "ev_big"]
ATTRIBUTES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: record_id, analytic_year, hospitalized, vaccines, event flags."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    per_order = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("p_brand")).alias("vaccines"),
        F.bool_or(F.col("l_returnflag") == "R").alias("ev_returned"),
        F.bool_or(F.col("l_quantity") >= 45).alias("ev_bulk"),
        F.bool_or(F.col("l_linestatus") == "O").alias("ev_open"),
    )
    orders = table(spark, sf, "orders")
    return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("record_id"),
        F.year("o_orderdate").alias("analytic_year"),
        F.to_date("o_orderdate").alias("report_date"),
        (F.col("o_orderstatus") == "F").alias("hospitalized"),
        "vaccines",
        "ev_returned",
        (F.col("o_orderpriority") == "1-URGENT").alias("ev_urgent"),
        "ev_bulk",
        "ev_open",
        (F.col("o_totalprice") > 250000).alias("ev_big"),
    )


def administrations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (record_id, vaccine)."""
    return reports(spark, sf).select("record_id", F.explode("vaccines").alias("vaccine"))


def event_long(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).unpivot(["record_id"], EVENTS, "event", "present")


def qc(spark: SparkSession, sf: str) -> DataFrame:
    """Measured lots: series (p_type), its order keys, and four attributes."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("series"))
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


QC_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]

_CTE = {
    "reports": """reports as (
  select o_orderkey as record_id, cast(year(o_orderdate) as integer) as analytic_year, cast(o_orderdate as date) as report_date,
         o_orderstatus = 'F' as hospitalized, list_sort(list(distinct p_brand)) as vaccines,
         bool_or(l_returnflag = 'R') as ev_returned, o_orderpriority = '1-URGENT' as ev_urgent, bool_or(l_quantity >= 45) as ev_bulk,
         bool_or(l_linestatus = 'O') as ev_open, o_totalprice > 250000 as ev_big
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  group by o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice)""",
    "administrations": "administrations as (select record_id, unnest(vaccines) as vaccine from reports)",
    "event_long": "event_long as (unpivot (select record_id, ev_returned, ev_urgent, ev_bulk, ev_open, ev_big from reports) on ev_returned, ev_urgent, ev_bulk, ev_open, ev_big into name event value present)",
    "qc": "qc as (select l.*, p_type as series from lineitem l join part on p_partkey = l_partkey)",
}


def ctes(*names: str) -> str:
    """WITH and the views named, in order."""
    return "with " + ",\n".join(_CTE[n] for n in names)
