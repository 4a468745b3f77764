"""Long tables of flags, ages and stays, and the summaries that a study reports: flows, schedules, links, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands of ages in months, each from its edge up to the next.
AGE_BANDS = {-0.01: "0-2m", 2: "2-4m", 4: "4-6m", 6: "6-11m", 12: "12-23m", 24: "2-5y", 72: "6-14y", 180: "15-60y", 732: "61y+"}
LEVELS = ["exact", "core", "fuzzy"]
INCONSISTENT = ["expired", "before_release"]


def age_band_label(months: Column) -> Column:
    """The band's name; null for unknown and negative ages."""
    return reduce(lambda out, kv: F.when(months >= kv[0], kv[1]).otherwise(out), AGE_BANDS.items(), F.lit(None).cast("string"))


def stays_and_ages(vaccinated: Column, notified: Column, admitted: Column, discharged: Column, months: Column) -> dict[str, Column]:
    """notification_delay_days, los_days, age_years, infant, age_band; each null where a part of it is unknown. Negative days stay, for the plausibility flags to find."""
    return {
        "notification_delay_days": F.datediff(notified, vaccinated), "los_days": F.datediff(discharged, admitted),
        "age_years": months.cast("double") / 12, "infant": months < 12, "age_band": age_band_label(months),
    }


def long_flags(df: DataFrame, key: str, flags: list[str], name: str = "event") -> DataFrame:
    """key, name, present: a row for each flag of each record. Flags that no record has a value of belong to a form that isn't in the data, and are left out."""
    filled = df.agg(*[F.count(c).alias(c) for c in flags]).first() if flags else {}
    kept = [c for c in flags if filled[c]]
    typed = df.select(key, *[F.col(c).cast("boolean").alias(c) for c in kept])
    if not kept:
        return typed.where("false").select(key, F.lit("").alias(name), F.lit(None).cast("boolean").alias("present"))
    return typed.unpivot([key], kept, name, "present")


def history(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """key, condition, present, type: long_flags() of hist_personal_* and hist_family_*."""
    long = long_flags(df, key, flags, "_c")
    kind = F.when(F.col("_c").startswith("hist_personal"), "personal").otherwise("family")
    return long.select(key, F.regexp_replace("_c", "^hist_(personal|family)_", "").alias("condition"), "present", kind.alias("type"))


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def population_flow(window: DataFrame) -> DataFrame:
    """One row of counts, from one pass over the reports of the window with has_target, comparator, schedule_invalid and coadministered."""
    t, comp, bad, co = _yes("has_target"), _yes("comparator"), _yes("schedule_invalid"), _yes("coadministered")
    counts = {
        "n_target": t, "n_target_schedule_invalid": t & bad, "n_target_analysed": t & ~bad, "n_target_coadministered": t & ~bad & co,
        "n_comparator": comp, "n_neither": ~t & ~comp, "n_population": (t & ~bad) | comp,
    }
    return window.agg(F.count(F.lit(1)).alias("n_window"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def comparator_product_counts(reports: DataFrame, products: list[str]) -> DataFrame:
    """vaccine, n: comparator reports with each of the products; a report with two counts for both, products without a report have no row."""
    met = F.array_intersect("vaccines", F.array(*[F.lit(p) for p in products]))
    return reports.where(_yes("comparator")).select(F.explode(met).alias("vaccine")).groupBy("vaccine").agg(F.count(F.lit(1)).alias("n"))


def schedule_summary(window: DataFrame) -> DataFrame:
    """analytic_year, status, n of the target's reports; the year is null in the rows over all years."""
    target = window.where(_yes("has_target")).select("analytic_year", F.coalesce("schedule_status", F.lit("unknown")).alias("status"))
    per = target.groupBy("analytic_year", "status").agg(F.count(F.lit(1)).alias("n"))
    return per.where("analytic_year is not null").unionByName(per.groupBy("status").agg(F.sum("n").alias("n")).withColumn("analytic_year", F.lit(None).cast("int")))


def window_summary(reports: DataFrame, first: int, last: int) -> DataFrame:
    """One row: reports in and outside of the study's years, those whose year isn't their file's, and the files' years."""
    inside = F.coalesce(F.col("analytic_year").between(first, last), F.lit(False))
    differs = F.coalesce(F.col("analytic_year") != F.col("file_year"), F.lit(False))
    years = F.array_sort(F.collect_set("file_year"))
    return reports.agg(
        F.count(F.lit(1)).alias("n_reports_total"), F.count_if(inside).alias("n_in_window"), F.count_if(~inside).alias("n_outside_window"),
        F.count_if(differs).alias("n_year_differs_from_file"), years.alias("file_years"),
    )


def _assessed() -> tuple[Column, Column, Column]:
    """(linked, assessable, inconsistent) of a row of links."""
    status = F.coalesce("lot_status", F.lit("not_assessable"))
    return F.col("lot_key").isNotNull(), status != "not_assessable", status.isin(INCONSISTENT)


def link_summary(links: DataFrame) -> DataFrame:
    """One row over links(record_id, analytic_year, lot_key, match_level, temporal_ok, lot_status): how many reports found their lot and at which level, and how many of the lots can't be right."""
    linked, assessable, bad = _assessed()
    status = F.col("lot_status")
    one = links.agg(
        F.count(F.lit(1)).alias("n_target_reports"), F.count_if(linked).alias("n_linked"), F.countDistinct("lot_key").alias("n_distinct_lots_linked"),
        F.count_if(~F.col("temporal_ok")).alias("temporal_implausible"), F.count_if(assessable).alias("n_lot_assessable"), F.count_if(bad).alias("n_lot_inconsistent"),
        F.count_if(status == "expired").alias("n_lot_expired"), F.count_if(status == "before_release").alias("n_lot_before_release"),
        F.count_if(linked & bad).alias("n_linked_inconsistent"), *[F.count_if(F.col("match_level") == k).alias(f"n_{k}") for k in LEVELS],
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))  # noqa: E731  null without rows
    return one.withColumns({"link_rate": share("n_linked", "n_target_reports"), "lot_inconsistent_share": share("n_lot_inconsistent", "n_lot_assessable")})


def link_counts(links: DataFrame, by: str) -> DataFrame:
    """by (analytic_year, match_level, lot_status): n_reports, n_linked, n_assessable, n_inconsistent."""
    linked, assessable, bad = _assessed()
    return links.groupBy(by).agg(F.count(F.lit(1)).alias("n_reports"), F.count_if(linked).alias("n_linked"), F.count_if(assessable).alias("n_assessable"), F.count_if(bad).alias("n_inconsistent"))


def signal_groups(signals: DataFrame, flag: str, primary: str, apart: str, expected: DataFrame) -> DataFrame:
    """event, n_designs, robust, expected, emerging of the events that the primary design flags, and influence, whether design `apart` does.

    signals(design, event, flag). Robust is what every comparator design flags; the
    design `apart` asks another question and has no say in it. A design without the
    event doesn't flag it. expected(event) is a declared list; all others emerge.
    """
    yes = F.coalesce(F.col(flag), F.lit(False))
    designs = signals.where(F.col("design") != apart).agg(F.countDistinct("design")).scalar()
    per = signals.groupBy("event").agg(
        F.bool_or(yes & (F.col("design") == primary)).alias("_primary"), F.countDistinct(F.when(yes & (F.col("design") != apart), F.col("design"))).alias("n_designs"),
        F.bool_or(yes & (F.col("design") == apart)).alias("influence"),
    )
    per = per.where("_primary").withColumn("robust", F.col("n_designs") == designs)
    known = expected.select("event").distinct().withColumn("_known", F.lit(True))
    out = per.join(known, "event", "left").withColumn("expected", F.col("_known").isNotNull())
    return out.select("event", "n_designs", "robust", "influence", "expected", (~F.col("expected")).alias("emerging"))


def public_drift(drift: DataFrame, forbidden: list[str]) -> DataFrame:
    """field, in_all, n of a schema_drift(): the files of each field. Names of persons' fields would give away what a form asks: those that some files lack are one row without a name, whose n counts the fields; those in all files have none."""
    named = drift.where(~F.col("field").isin(forbidden)).select("field", "in_all", F.col("n_files").alias("n"))
    hidden = drift.where(F.col("field").isin(forbidden) & ~F.col("in_all")).agg(F.count(F.lit(1)).alias("n"))
    return named.unionByName(hidden.select(F.lit(None).cast("string").alias("field"), F.lit(False).alias("in_all"), "n"))
