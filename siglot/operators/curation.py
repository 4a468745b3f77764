"""De-duplication, derived variables, data-quality flags and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_dedup(df: DataFrame, digest: list[str], order: list[str]) -> DataFrame:
    """The first row, in the order given, of rows that agree in the digest columns."""
    w = Window.partitionBy(*digest).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_three_valued(c: Column) -> Column:
    """Any true: true; else any false: false; else unknown."""
    return F.bool_or(c)


def key_dedup(df: DataFrame, key: list[str], flags: list[str], dates: list[str], firsts: list[str], order: Column) -> DataFrame:
    """One row per key (null parts are equal): flags merged, dates the least, other columns the first known in order; n_merged."""
    aggs = [merge_three_valued(F.col(c)).alias(c) for c in flags] + [F.min(c).alias(c) for c in dates]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in firsts]
    return df.groupBy(*key).agg(*aggs, F.count(F.lit(1)).alias("n_merged"))


def analytic_year(primary: Column, other: Column, file_year: Column) -> tuple[Column, Column]:
    source = F.when(primary.isNotNull(), "primary").when(other.isNotNull(), "other").otherwise("file")
    return F.coalesce(F.year(primary), F.year(other), file_year), source


def positional(products: Column, target: str, values: Column) -> tuple[Column, Column]:
    """(the target's value by position, how): equal lengths go by position, a single value is everyone's, else it is ambiguous."""
    at = F.array_position(products, target)
    n, m = F.size(products), F.coalesce(F.size(values), F.lit(0))
    how = F.when(at == 0, "none").when(n == 1, F.when(m >= 1, "single_vaccine").otherwise("none")).when(m == n, "positional").when(m == 1, "single_vaccine").when(m == 0, "none").otherwise("ambiguous")
    value = F.when(how == "positional", F.get(values, (at - 1).cast("int"))).when((how == "single_vaccine"), F.get(values, F.lit(0)))
    return value, how


def schedule_status(age: Column, exact: Column, dose: Column, schedule: dict[str, tuple[float, float, float]], max_years: float, booster: bool = False) -> Column:
    """schedule: dose -> (least months, routine from, routine to)."""
    upper = F.when(exact, age).otherwise(age + F.when(age >= 12, 12.0).otherwise(1.0))
    pick = lambda k: F.coalesce(*[F.when(dose == d, F.lit(float(v[k]))) for d, v in schedule.items()])
    return (
        F.when(dose.isNull() | dose.isin("", "U"), "unknown_dose").when(dose == "R", "booster" if booster else "booster_campaign").when(~dose.isin(list(schedule)), "dose_not_in_schedule")
        .when(age.isNull(), "unknown_age").when(upper < pick(0), "too_young").when(age > max_years * 12, "above_indication")
        .when(age < pick(1), "early").when(age < pick(2), "on_schedule").otherwise("late")
    )


def age_band(months: Column, edges: tuple[float, ...] = (-0.01, 2, 4, 6, 12, 24, 72, 180, 732)) -> Column:
    """Index of the band [edge, next edge) that holds the age."""
    out = F.when(months < edges[0], None)
    for i, hi in enumerate(edges[1:]):
        out = out.when(months < hi, i)
    return out


def plausibility(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """by, flag, n, flagged, pct: every flag of every group from one aggregation; an unknown flag is not flagged."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    long = wide.unpivot([by, "n"], list(flags), "flag", "flagged")
    return long.withColumn("pct", F.round(100.0 * F.col("flagged") / F.col("n"), 4))


def plausibility_flags(most_delay: int = 730, most_stay: int = 365) -> dict[str, Column]:
    """The flags of a report, from columns of these names: vaccination_date, notification_date, birth_date, admission_date, discharge_date, age_months, age_source, age_group, age_group_reported, hospitalized, pregnant, sex, recovered, died, n_events, other_categories, vaccines, has_target, target_lots, schedule_invalid, vaccination_date_rule, notification_date_rule, month_reported. An unknown condition flags nothing."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    delay, stay = F.datediff("notification_date", "vaccination_date"), F.datediff("discharge_date", "admission_date")
    month = F.month("vaccination_date")
    flags = {
        "notification_before_vaccination": delay < 0, "notification_delay_implausible": delay > most_delay, "birth_after_vaccination": c("birth_date") > c("vaccination_date"),
        "discharge_before_admission": stay < 0, "stay_implausible": stay > most_stay, "admission_before_vaccination": c("admission_date") < c("vaccination_date"),
        "age_conflict": c("age_source") == "conflict_derived", "age_missing": c("age_months").isNull(), "age_group_mismatch": c("age_group_reported") != c("age_group"),
        "hospitalized_without_date": c("hospitalized") & c("admission_date").isNull(), "admission_date_not_hospitalized": ~c("hospitalized") & c("admission_date").isNotNull(),
        "pregnant_male": c("pregnant") & (c("sex") == "M"), "pregnant_age_implausible": c("pregnant") & ~yes(F.floor(c("age_months") / 12).between(10, 55)),
        "recovered_and_died": c("recovered") & c("died"), "no_event_marked": (c("n_events") == 0) & c("other_categories").isNull(),
        "unmapped_vaccine": F.exists("vaccines", lambda v: v.startswith("X:")), "target_lot_missing": c("has_target") & c("target_lots").isNull(), "schedule_invalid": c("schedule_invalid"),
    }
    for what in ("vaccination", "notification"):
        flags |= {f"{what}_year_imputed": c(f"{what}_date_rule") == "imputed_year", f"{what}_year_dropped": c(f"{what}_date_rule") == "dropped_impossible"}
    flags["month_mismatch"] = (c("month_reported") != month) & (c("month_reported") != F.month("notification_date"))
    return {k: yes(v) for k, v in flags.items()}


def completeness(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by, field, n, filled, pct."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in fields])
    return wide.unpivot([by, "n"], fields, "field", "filled").withColumn("pct", F.round(100.0 * F.col("filled") / F.col("n"), 4))


def conformance(df: DataFrame, by: str, status: dict[str, Column], kinds: list[str]) -> DataFrame:
    """by, field, and a count for each parse status."""
    wide = df.select(by, *[c.alias(k) for k, c in status.items()])
    long = wide.unpivot([by], list(status), "field", "status")
    return long.groupBy(by, "field").pivot("status", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def month_coverage(df: DataFrame, year: str, month: str, least_share: float = 0.1) -> DataFrame:
    """year, month, n_reports, observed for all twelve months of each year: a month counts as present from a share of the median month on, and what lies between present months is observed."""
    counts = df.where(f"{year} is not null and {month} is not null").groupBy(year, month).agg(F.count(F.lit(1)).alias("n_reports"))
    median = counts.groupBy(year).agg(F.expr("percentile(n_reports, 0.5)").alias("med"))
    present = counts.join(median, year).where(F.col("n_reports") >= F.greatest(F.lit(1.0), F.col("med") * least_share))
    ends = present.groupBy(year).agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    grid = df.where(f"{year} is not null").select(year).distinct().select(year, F.explode(F.sequence(F.lit(1), F.lit(12))).alias(month))
    full = grid.join(counts, [year, month], "left").join(ends, year, "left")
    return full.select(year, month, F.coalesce("n_reports", F.lit(0)).alias("n_reports"), F.coalesce(F.col(month).between(F.col("lo"), F.col("hi")), F.lit(False)).alias("observed"))


def partial_years(coverage: DataFrame, year: str) -> DataFrame:
    return coverage.groupBy(year).agg(F.count_if("observed").alias("observed_months")).where("observed_months < 12")


def recorded_everywhere(recorded: DataFrame) -> DataFrame:
    """Events of recorded(source_file, event) that every file's form had."""
    n = recorded.select("source_file").distinct().count()
    return recorded.groupBy("event").agg(F.countDistinct("source_file").alias("n_files")).where(F.col("n_files") == n).select("event")
