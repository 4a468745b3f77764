"""Queries of releases: protected tables, kept results, checks of a release's folder, and the fuzzy steps of headers and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglot.operators import parsing as P
from siglot.operators import publication as U
from siglot.plans.registry import query
from siglot.plans.views import table
from siglot.sources import files

_DQ = """with t as (select l_suppkey, cast(year(l_shipdate) * 100 + month(l_shipdate) as integer) as period, l_returnflag, nullif(l_tax, 0) as tax from lineitem),
c as (select l_suppkey, period, l_returnflag, count(*) as n, count(tax) as n_present, 100.0 * count(tax) / count(*) as pct, avg(tax) as mean from t group by 1, 2, 3),
p as (select *, case when n between 1 and 4 then 'primary' else 'visible' end as s, case when n between 1 and 4 then null else mean end as m2 from c),
w as (select *, count(*) filter (s <> 'visible') over (partition by l_suppkey, period) as h, row_number() over (partition by l_suppkey, period order by case when s = 'visible' and n > 0 then 0 else 1 end, case when s = 'visible' then n end, l_returnflag) as k from p),
f as (select *, case when h = 1 and k = 1 and s = 'visible' then 'secondary' else s end as st from w),
g as (select l_suppkey, period, l_returnflag, st as n_status, case when st = 'visible' then n end as n, case when n_present between 1 and 4 then null else n_present end as n_present, case when st = 'visible' and not n_present between 1 and 4 then pct end as pct, m2 as mean from f)
select l_suppkey, period, l_returnflag, n_status, n, n_present, round(case when not (round_even(n * pct / 100, 0) between 1 and 4 or n - round_even(n * pct / 100, 0) between 1 and 4) then pct end, 6) as pct, round(mean, 6) as mean from g"""

_RULES = U.Rules(counts={"n": ["pct"], "n_present": ["pct"]}, linked={"n": ["mean"]}, secondary=(["l_suppkey", "period"], "n"), implied=("n", ["pct"]))


def _quality(spark, sf):
    """Completeness of one field by supplier, month and flag: all lines, in cells that are often small."""
    d = table(spark, sf, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period"), "l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return d.groupBy("l_suppkey", "period", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("tax").alias("n_present"), (100.0 * F.count("tax") / F.count(F.lit(1))).alias("pct"), F.avg("tax").alias("mean"))


@query("s20_quality_tables", _DQ)
def _s20(spark, sf):
    d = U.protect(_quality(spark, sf), _RULES)
    return d.select("l_suppkey", "period", "l_returnflag", "n_status", "n", "n_present", "pct", "mean")


_SCALARS = "with t as (select l_suppkey, cast(year(l_shipdate) * 100 + month(l_shipdate) as integer) as period, count(*) as n, round(avg(l_quantity), 4) as mean from lineitem group by 1, 2)"


@query("x11_scalars", _SCALARS + " select l_suppkey, period, case when n between 1 and 4 then '<5' else cast(n as varchar) end as n, case when n between 1 and 4 then null else mean end as mean from t")
def _x11(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))
    return U.blank_profiles(d, "n", ["mean"]).withColumn("n", U.safe_scalar(F.col("n")))


@query("s15_written_release", _DQ.replace("select l_suppkey, period, l_returnflag, n_status, n, n_present, round(case", "select l_suppkey, period, l_returnflag, coalesce(cast(n as varchar), '<5') as n, coalesce(cast(n_present as varchar), '<5') as n_present, round(case"))
def _s15b(spark, sf):
    root = files.scratch(spark) + "/synthetic"
    U.write_release(spark, root, {"quality": (_quality(spark, sf), _RULES)})
    return spark.read.schema("l_suppkey bigint, period int, l_returnflag string, n string, n_present string, pct double, mean double").csv(f"{root}/tables/quality", header=True)


@query("x13_verify_release", _SCALARS + """ select 'small_count' as rule, count(*) as n from t where n between 1 and 4 having count(*) > 0 union all select 'column', 1 union all select 'unlisted', 1 union all select 'day', count(*) from orders""")
def _x13b(spark, sf):
    """A release that forgot its small counts, and a table of orders that was added afterwards with a forbidden column and dates to the day."""
    root = files.scratch(spark) + "/synthetic"
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    U.write_release(spark, root, {"open": (d, U.Rules(counts={"n": []}))}, least=1)
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).write.option("maxRecordsPerFile", U.MOST_ROWS).csv(f"{root}/tables/late", header=True)
    found = U.verify_release(spark, root, ["record_id"], ["NOMBRES Y APELLIDOS"])
    return U.by_table(found).groupBy("rule").agg(F.sum("n").alias("n"))


@query("s18_kept_results", "select l_returnflag, count(*) as n, round(avg(l_tax), 6) as mean, 0 as scanned, 1 as warnings from lineitem group by 1")
def _s18(spark, sf):
    """The second run reads the first one's tables and no source; a rebuild with other settings warns."""
    root, source = files.scratch(spark), f"{sf}/lineitem.parquet"
    make = {"rates": lambda: spark.read.parquet(source).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax"), 6).alias("mean"))}
    U.kept_results(spark, root, [source], {"digits": 6}, make)
    again = U.kept_results(spark, root, [source], {"digits": 6}, make)["rates"]
    _, warnings = U.rebuilt(spark, root, {"digits": 7})
    scanned = sum(source.rstrip("/") in f for f in again.inputFiles())
    return again.withColumns({"scanned": F.lit(scanned), "warnings": F.lit(len(warnings))})


@query("s4_fuzzy_headers", """with h as (select distinct source, lang from documents)
select source as file, case lang when 'en' then 'Fecha de vacunacion' when 'de' then 'FECHA VACUNACIÒN' when 'fr' then 'provincia' else 'prov' end as header, case lang when 'en' then 'vaccination_date' when 'fr' then 'province' end as field,
case lang when 'en' then 'exact' when 'fr' then 'exact' else 'unmatched' end as how from h where lang <> 'de' or lang = 'xx'
union all select source, 'Fecha de vacunaciom', null, 'unmatched' from h where lang = 'de' union all select source, 'Fecha de notifcacion', 'notification_date', 'fuzzy' from (select distinct source from h where lang = 'en')""")
def _s4b(spark, sf):
    """A second, misspelt date can't take the field that the right header has; a misspelt one alone is found, a short one isn't."""
    d = table(spark, sf, "documents").select(F.col("source").alias("file"), "lang").distinct()
    name = F.when(F.col("lang") == "en", F.array(F.lit("Fecha de vacunacion"), F.lit("Fecha de notifcacion"))).when(F.col("lang") == "de", F.array(F.lit("Fecha de vacunaciom"))).when(F.col("lang") == "fr", F.array(F.lit("provincia"))).otherwise(F.array(F.lit("prov")))
    h = d.select("file", "lang", F.explode(name).alias("header")).withColumn("position", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 100).when(F.col("lang") == "fr", 200).otherwise(300) + F.length("header"))
    aliases = spark.createDataFrame([("vaccination_date", "Fecha de vacunacion", 1, None), ("notification_date", "Fecha de notificacion", 1, None), ("province", "provincia", 1, None)], "field string, alias string, occurrence int, pattern string")
    return files.match_headers(h, aliases).select("file", "header", "field", "how")


@query("c20_fuzzy_tokens", """select p_partkey, case p_type when 'ECONOMY' then 'ECO' when 'STANDARD' then 'STD' else 'X:' || reverse(p_type) end as code, case p_type when 'ECONOMY' then 'regex' when 'STANDARD' then 'fuzzy' else 'unmapped' end as rule from part""")
def _c20b(spark, sf):
    """Economy by a pattern, a misspelt standard by its anchor, and the rest, written backwards, by nothing."""
    t = F.col("p_type")
    raw = F.when(t == "ECONOMY", "ECONOMY").when(t == "STANDARD", "STANDRD").otherwise(F.reverse(t))
    rules = spark.createDataFrame([(1, "ECO.*", "ECO")], "position int, pattern string, code string")
    anchors = spark.createDataFrame([("STD", "Standard"), ("XXL", "Extra large")], "code string, anchor string")
    return P.map_tokens(table(spark, sf, "part").select("p_partkey", raw.alias("token")), rules, anchors=anchors).drop("token")
