"""Statistical disclosure control of count tables, and checks of what is released."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(n: Column, least: int = 5) -> Column:
    """A count that must not be shown: 1 to least - 1. Zeros may."""
    return F.coalesce((n > 0) & (n < least), F.lit(False))


def suppress(df: DataFrame, counts: dict[str, list[str]], least: int = 5) -> DataFrame:
    """Each count column with a status column (visible or primary); small counts, and what is derived from them, become unknown. counts: column -> derived columns."""
    flags = {c: small(F.col(c), least) for c in counts}
    new = {f"{c}_status": F.when(f, "primary").otherwise("visible") for c, f in flags.items()} | {c: F.when(~f, F.col(c)) for c, f in flags.items()}
    for c, derived in counts.items():
        new |= {d: F.when(~flags[c], F.col(d)) for d in derived}
    return df.withColumns(new)


def suppress_linked(df: DataFrame, trigger: str, measures: list[str], least: int = 5) -> DataFrame:
    return df.withColumns({m: F.when(~small(F.col(trigger), least), F.col(m)) for m in measures})


def suppress_secondary(df: DataFrame, block: list[str], n: str, status: str = "status") -> DataFrame:
    """df(block, n, status): where a block has exactly one hidden cell, its smallest visible positive one is hidden too, as its total would tell the other."""
    w = Window.partitionBy(*block)
    hidden = F.count_if(F.col(status) != "visible").over(w)
    place = F.row_number().over(w.orderBy(F.when((F.col(status) == "visible") & (F.col(n) > 0), 0).otherwise(1), n, *[c for c in df.columns if c not in (*block, n, status)]))
    also = (hidden == 1) & (place == 1) & (F.col(status) == "visible") & (F.col(n) > 0)
    d = df.withColumn("_also", also)
    return d.withColumns({status: F.when(F.col("_also"), "secondary").otherwise(F.col(status))}).drop("_also")


def suppress_cross(df: DataFrame, block: list[str], row: str, col: str, n: str, least: int = 5) -> DataFrame:
    """block, row, col, n, status: in every block's table, lines of exactly one hidden cell lose their smallest positive other cell too, columns then rows, until none is left. A block is a small published table; many blocks run side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        status = pd.Series(["primary" if 0 < v < least else "visible" for v in pdf["n"]], index=pdf.index)
        changed = True
        while changed:
            changed = False
            for line in ("col", "row"):
                for _, ix in sorted(pdf.groupby(line).groups.items(), key=lambda kv: str(kv[0])):
                    if (status[ix] != "visible").sum() == 1:
                        rest = [i for i in ix if status[i] == "visible" and pdf.at[i, "n"] > 0]
                        if rest:
                            status[min(rest, key=lambda i: (pdf.at[i, "n"], str(pdf.at[i, "row"]), str(pdf.at[i, "col"])))] = "secondary"
                            changed = True
        return pdf.assign(status=status)

    d = df.select(F.to_json(F.struct(*block)).alias("block"), F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), F.col(n).cast("bigint").alias("n"))
    return d.groupBy("block").applyInPandas(run, "block string, row string, col string, n bigint, status string")


def implied(n: Column, pct: Column, least: int = 5, scale: float = 100.0) -> Column:
    """A percentage that tells a small count, or a small complement."""
    k = F.bround(n * pct / scale, 0)
    return F.when(~(k.between(1, least - 1) | (n - k).between(1, least - 1)), pct)


def nested_designs(df: DataFrame, primary: str, least: int = 5) -> DataFrame:
    """df(design, event, a, b, c, d) with withheld: a design that differs from the primary one by a small number in any cell."""
    p = df.where(F.col("design") == primary).select("event", *[F.col(k).alias(f"p_{k}") for k in "abcd"])
    near = F.lit(False)
    for k in "abcd":
        near = near | F.coalesce(F.abs(F.col(k) - F.col(f"p_{k}")).between(1, least - 1), F.lit(False))
    return df.join(p, "event", "left").withColumn("withheld", (F.col("design") != primary) & near).drop(*[f"p_{k}" for k in "abcd"])


def cumulative(df: DataFrame, key: str, order: str, n: str, least: int = 5) -> DataFrame:
    """df with released: a row is withheld if it adds a small number to the last row released. A series has as many rows as years."""
    s = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(n).alias("n")))).alias("s"))
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<struct<o:int,ok:boolean>>").alias("out"))

    def step(acc, x):
        ok = ~(x["n"] - acc["last"]).between(1, least - 1)
        return F.struct(F.when(ok, x["n"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), ok.alias("ok")))).alias("out"))

    kept = s.select(key, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.ok").alias("released"))
    return df.join(kept, [key, order])


def complement(total: Column, part: Column, least: int = 5) -> Column:
    """Whether a part may be shown beside its total."""
    return ~small(total - part, least) & ~small(part, least)


def safe_total(df: DataFrame, key: list[str], n: str, visible: str) -> DataFrame:
    """key, total: only where every part is visible."""
    return df.groupBy(*key).agg(F.when(F.bool_and(visible), F.sum(n)).alias("total"))


def log_table(df: DataFrame, table: str, status: str) -> DataFrame:
    return df.where(F.col(status) != "visible").groupBy(F.lit(table).alias("table"), F.col(status).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, forbidden: list[str], patterns: dict[str, str], counts: list[str], least: int = 5) -> DataFrame:
    """rule, column, n of a table to be released: forbidden columns, forbidden patterns in text, small counts, dates to the day."""
    out = [F.struct(F.lit("forbidden_column").alias("rule"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("n")) for c in df.columns if c in forbidden]
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            out += [F.struct(F.lit(k).alias("rule"), F.lit(f.name).alias("column"), F.count_if(F.col(f.name).rlike(p)).alias("n")) for k, p in patterns.items()]
            out.append(F.struct(F.lit("day_precision").alias("rule"), F.lit(f.name).alias("column"), F.count_if(F.col(f.name).rlike(r"\b\d{4}-\d{2}-\d{2}\b")).alias("n")))
    out += [F.struct(F.lit("small_count").alias("rule"), F.lit(c).alias("column"), F.count_if(small(F.col(c), least)).alias("n")) for c in counts]
    return df.agg(*[x.alias(f"v{i}") for i, x in enumerate(out)]).select(F.explode(F.array(*[F.col(f"v{i}") for i in range(len(out))])).alias("v")).select("v.*").where("n > 0")
