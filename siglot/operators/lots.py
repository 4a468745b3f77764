"""Sheets of lots: the row of limits below the header, the lots below it, and the scales that limits make."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglot.operators.parsing import cell, core_key, exact_key, integer, normalize, number, spec, split_multi

SPEC = "struct<op:string,low:double,high:double,unit:string>"


def _at(columns: dict[str, int], name: str) -> Column:
    return F.get("cells", F.lit(columns[name]))


def split_spec_row(grid: DataFrame, columns: dict[str, int], quantitative: list[str], lot_id: str = "lot_id") -> tuple[DataFrame, DataFrame]:
    """(rows of limits, rows of data) of grid(file, row, start, cells), where start is the first row below the file's header.

    That row holds limits if at least two, and a third, of the quantitative cells
    are limits and no numbers, and there is a blank or a limit where a lot's name
    would be. A file without such a row is all data.
    """
    limits = [(spec(_at(columns, c))["op"] != "qualitative") & number(_at(columns, c))["value"].isNull() for c in quantitative]
    n = sum((x.cast("int") for x in limits[1:]), limits[0].cast("int"))
    blank = (F.coalesce(normalize(_at(columns, lot_id)), F.lit("")) == "") | (spec(_at(columns, lot_id))["op"] != "qualitative")
    is_spec = (F.col("row") == F.col("start")) & (F.coalesce(n, F.lit(0)) >= max(2, len(quantitative) // 3)) & blank
    below = grid.where("row >= start").withColumn("_spec", F.coalesce(is_spec, F.lit(False)))
    return below.where("_spec").drop("_spec"), below.where("not _spec").drop("_spec")


def sheet_specs(grid: DataFrame, limits: DataFrame, columns: dict[str, int], quantitative: list[str], documented: DataFrame) -> DataFrame:
    """file, attribute, op, low, high, unit, source, drift: the limits of each file's sheet, or the documented ones where it states none; drift where the two aren't the same.

    documented(attribute, op, low, high, unit) is a declared list.
    """
    one = F.array(*[F.struct(F.lit(c).alias("attribute"), spec(_at(columns, c)).cast(SPEC).alias("s")) for c in quantitative])
    stated = limits.select("file", F.explode(one).alias("x")).select("file", "x.attribute", "x.s").where("s.op <> 'qualitative'")
    fallback = documented.select("attribute", F.struct("op", "low", "high", "unit").cast(SPEC).alias("d"))
    names = grid.select("file").distinct().select("file", F.explode(F.array(*[F.lit(c) for c in quantitative])).alias("attribute"))
    both = names.join(stated, ["file", "attribute"], "left").join(F.broadcast(fallback), "attribute", "left")
    near = lambda k: F.when(F.col(f"s.{k}").isNull() | F.col(f"d.{k}").isNull(), F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}"))).otherwise(F.abs(F.col(f"s.{k}") - F.col(f"d.{k}")) <= 1e-9 * F.greatest(F.lit(1e-300), F.abs(f"s.{k}"), F.abs(f"d.{k}")))
    side = lambda x: F.replace(F.col(x), F.lit("t"), F.lit("e"))  # noqa: E731  strict or not is no drift
    same = (side("s.op") == side("d.op")) & near("low") & near("high")
    both = both.withColumn("drift", F.col("d").isNotNull() & ~F.coalesce(same, F.lit(False))).withColumn("source", F.when(F.col("s").isNotNull(), "sheet").otherwise("documented"))
    return both.withColumn("x", F.coalesce("s", "d")).where("x is not null").select("file", "attribute", "x.op", "x.low", "x.high", "x.unit", "source", "drift")


def lots_table(data: DataFrame, columns: dict[str, int], quantitative: list[str], qualitative: dict[str, list[str]], destination: Callable[[Column], Column], home: str, year: str = "production_year", lot_id: str = "lot_id", destinations: str = "destinations") -> DataFrame:
    """One row per lot: file, row, lot_id, lot_exact, lot_core, the year, the numbers, <name>_text and <name>_pass, destination_codes, national, n_destinations.

    Rows whose lot has no digit are footnotes and go. A qualitative result passes
    if its text begins with one of its words; blanks and dashes are unknown.
    destination gives a token's code (null: OTHER); a lot is national if `home` is
    among them, also beside others.
    """
    name = F.trim(cell(_at(columns, lot_id)))
    out = data.where(name.rlike("[0-9]"))
    text = lambda c: normalize(_at(columns, c))
    codes = F.array_sort(F.array_distinct(F.transform(split_multi(_at(columns, destinations)), lambda t: F.coalesce(destination(t), F.lit("OTHER")))))
    passes = []
    for c, words in qualitative.items():
        hit = reduce(lambda a, b: a | b, [F.startswith(text(c), F.lit(w)) for w in words])
        passes += [F.nullif(text(c), F.lit("")).alias(f"{c}_text"), F.when(F.coalesce(text(c), F.lit("")) != "", hit).alias(f"{c}_pass")]
    out = out.select(
        "file", "row", name.alias("lot_id"), exact_key(name).alias("lot_exact"), core_key(name).alias("lot_core"), integer(_at(columns, year))["value"].alias(year),
        *[number(_at(columns, c))["value"].alias(c) for c in quantitative], *passes, F.when(F.size(codes) > 0, codes).alias("destination_codes"),
    )
    return out.withColumns({"national": F.coalesce(F.array_contains("destination_codes", home), F.lit(False)), "n_destinations": F.coalesce(F.size("destination_codes"), F.lit(0))})


TRANSFORMS: dict[str | None, Callable[[Column], Column]] = {
    None: lambda c: c, "log2": lambda c: F.when(c > 0, F.log2(c)), "log10": lambda c: F.when(c > 0, F.log10(c)), "log10p1": lambda c: F.when(c > -1, F.log10(1 + c)),
}


def attribute_scales(specs: DataFrame, lots: DataFrame, attributes: list[str], transforms: dict[str, str], natural: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """attribute, low, high, window_low, window_high, one_sided of specs(attribute, op, low, high), on the transformed scale.

    A window runs between the limits; where there is but one, its other end is the
    attribute's natural bound, or the utmost value of the lots (one pass over them
    for all attributes), or one away. An empty window is one wide.
    """
    at = lambda c, x: TRANSFORMS[transforms.get(c)](x.cast("double"))
    known = lambda c: F.when(~F.isnan(at(c, F.col(c))), at(c, F.col(c)))
    ends = lots.agg(F.array(*[F.struct(F.lit(c).alias("attribute"), F.min(known(c)).alias("least"), F.max(known(c)).alias("most")) for c in attributes]).alias("e"))
    ends = ends.select(F.explode("e").alias("e")).select("e.*")
    bound = lambda c, i: at(c, F.lit((natural.get(c) or (None, None))[i]).cast("double"))
    pick = lambda f: F.coalesce(*[F.when(F.col("attribute") == c, f(c)) for c in attributes])
    d = specs.where(F.col("attribute").isin(attributes)).where("low is not null or high is not null").join(F.broadcast(ends), "attribute", "left")
    d = d.withColumns({"_lo": pick(lambda c: at(c, F.col("low"))), "_hi": pick(lambda c: at(c, F.col("high"))), "_nlo": pick(lambda c: bound(c, 0)), "_nhi": pick(lambda c: bound(c, 1))})
    wl = F.coalesce("_lo", "_nlo", "least", F.col("_hi") - 1)
    wh = F.coalesce("_hi", "_nhi", "most", F.col("_lo") + 1)
    side = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNull(), "lower").when(F.col("_lo").isNull() & F.col("_hi").isNotNull(), "upper")
    return d.select(*[c for c in specs.columns if c not in ("low", "high")], F.col("_lo").alias("low"), F.col("_hi").alias("high"), wl.alias("window_low"), F.when(wh <= wl, wl + 1).otherwise(wh).alias("window_high"), side.alias("one_sided"))
