"""Reading drifting delimited files, headers and annual series, and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, which only a local master may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-siglot-")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex[:12]}"


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, name (the pattern's first group), year in the name: one row per input file, in order."""
    f = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    named = f.select("file", F.regexp_extract("file", pattern, 1).alias("name"), F.nullif(F.regexp_extract("file", r"((?:19|20)\d{2})", 1), F.lit("")).cast("int").alias("year"))
    return named.orderBy("year", "file")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text; blank cells null, trailing blanks cut."""
    raw = spark.read.csv(path, header=False, inferSchema=False, nullValue="", ignoreTrailingWhiteSpace=True)
    return raw.select(*[F.nullif(F.rtrim(c), F.lit("")).alias(c) for c in raw.columns])


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.csv(path)
    raw = read_raw(df.sparkSession, path)
    return raw.select(*[F.col(r).cast(f.dataType).alias(f.name) for r, f in zip(raw.columns, df.schema.fields, strict=True)])


def parquet_round_trip(df: DataFrame, partition: str) -> DataFrame:
    path = scratch(df.sparkSession)
    df.repartition(partition).write.partitionBy(partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def header_row(rows: DataFrame, aliases: DataFrame, first_rows: int = 15, least: int = 3) -> DataFrame:
    """file, row, matches: of each file's first rows the one with most cells that are exact aliases, the first of equals; files under the least number of matches are missing."""
    cells = rows.where(F.col("row") < first_rows).select("file", "row", F.explode("cells").alias("cell"))
    hits = cells.join(F.broadcast(aliases), F.trim("cell") == F.col("alias")).groupBy("file", "row").agg(F.count(F.lit(1)).alias("matches"))
    best = hits.groupBy("file").agg(F.max_by(F.struct("row", "matches"), F.struct("matches", -F.col("row"))).alias("b"))
    return best.select("file", "b.*").where(F.col("matches") >= least)


def match_headers(headers: DataFrame, aliases: DataFrame, fuzzy: float = 90.0, margin: float = 5.0) -> DataFrame:
    """file, header, occurrence, field, how: by the n-th occurrence of an exact alias, else by the one pattern that matches the whole header, else by similarity.

    A header is similar to the field with the best alias, if their ratio reaches
    `fuzzy` and leads the next field's by the margin; fields that a file has given
    away aren't in question, and of two headers the first gets the field.
    headers(file, position, header); aliases(field, alias, occurrence, pattern), a
    short declared list.
    """
    from pyspark.sql import Window

    from siglot.operators.linkage import ratio

    n = headers.withColumn("occurrence", F.row_number().over(Window.partitionBy("file", "header").orderBy("position")))
    exact = n.join(F.broadcast(aliases.where("alias is not null").select("field", F.col("alias").alias("header"), "occurrence")), ["header", "occurrence"]).withColumn("how", F.lit("exact"))
    rest = n.join(exact.select("file", "position"), ["file", "position"], "left_anti")
    by_pattern = rest.join(F.broadcast(aliases.where("pattern is not null").select("field", "pattern")), F.expr("header rlike concat('^(?:', pattern, ')$')"))
    one = by_pattern.groupBy("file", "position", "header", "occurrence").agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("field")).where("n = 1").withColumn("how", F.lit("pattern"))
    cols = ["file", "position", "header", "occurrence", "field", "how"]
    found = exact.select(cols).unionByName(one.select(cols))
    rest = rest.join(one.select("file", "position"), ["file", "position"], "left_anti")
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    known = aliases.where("alias is not null").select("field", key(F.col("alias")).alias("_alias"), "occurrence")
    pairs = rest.withColumn("_key", key(F.col("header"))).where("_key <> ''").join(F.broadcast(known), "occurrence").join(found.select("file", "field"), ["file", "field"], "left_anti")
    pairs = pairs.withColumn("ratio", ratio("_key", "_alias")).groupBy("file", "position", "header", "occurrence", "field").agg(F.max("ratio").alias("ratio"))
    w = Window.partitionBy("file", "position").orderBy(F.desc("ratio"), "field")
    best = pairs.withColumns({"_place": F.row_number().over(w), "_next": F.lead("ratio").over(w)}).where((F.col("_place") == 1) & (F.col("ratio") >= fuzzy) & (F.col("_next").isNull() | (F.col("ratio") - F.col("_next") >= margin)))
    first = F.row_number().over(Window.partitionBy("file", "field").orderBy("position"))
    like = best.withColumn("_first", first).where("_first = 1").withColumn("how", F.lit("fuzzy")).select(cols)
    none = rest.join(like.select("file", "position"), ["file", "position"], "left_anti").select("file", "position", "header", "occurrence", F.lit(None).cast("string").alias("field"), F.lit("unmatched").alias("how"))
    return found.unionByName(like).unionByName(none)


def schema_drift(mapping: DataFrame) -> DataFrame:
    """field, n_files, in_all: from a mapping(file, field, how)."""
    total = mapping.select("file").distinct().count()
    per = mapping.where("field is not null").groupBy("field").agg(F.countDistinct("file").alias("n_files"), F.bool_or(F.col("how") != "exact").alias("inexact"))
    return per.withColumn("in_all", F.col("n_files") == total)


def union_drifting(parts: dict[str, DataFrame], optional: list[str]) -> DataFrame:
    """Files with different columns, one below the other; an absent column is null and says so."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("file", F.lit(name)).withColumns({f"{c}_status": F.lit("ok" if c in df.columns else "absent_column") for c in optional})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def annual_series(df: DataFrame, year: str, low: int = 1900, high: int = 2100) -> DataFrame:
    """Rows with a year in range, in order; a year that repeats is an error."""
    good = df.withColumn(year, F.col(year).try_cast("int")).where(F.col(year).between(low, high))
    twice = good.groupBy(year).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"year {twice[0][0]} occurs {twice[0][1]} times")
    return good.orderBy(year)


def json_object(fields: dict[str, Column]) -> Column:
    """Sorted keys; NaN as null."""
    clean = [F.when(F.coalesce(F.isnan(c.try_cast("double")), F.lit(False)), None).otherwise(c).alias(k) for k, c in sorted(fields.items())]
    return F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file under path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_table(df: DataFrame, path: str, digits: int = 6) -> None:
    """A release table: floats rounded, one header, CSV."""
    cols = [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).coalesce(1).write.csv(path, header=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: iterations read it instead of running its plan again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
