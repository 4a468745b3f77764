"""Releases: one chain of disclosure control over a set of tables, kept results, and checks of what lies in a release's folder."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglot.operators import disclosure as X


@dataclass(frozen=True)
class Rules:
    """What a table must hide. counts: person counts and the columns derived from each; linked: a count and the measures that go with it; secondary: the columns of a block whose total is known, and the count; implied: a denominator and its percentages."""

    counts: dict[str, list[str]]
    linked: dict[str, list[str]] = field(default_factory=dict)
    secondary: tuple[list[str], str] | None = None
    implied: tuple[str, list[str]] | None = None


def protect(df: DataFrame, rules: Rules, least: int = 5, digits: int = 6) -> DataFrame:
    """df with what must be hidden as null, and a status column for each count: measures linked to small counts go first, while the counts can still be seen, then the counts with what is derived from them, then a second cell where a block would tell the one hidden, then percentages that imply a small count; at last floats are rounded."""
    for trigger, measures in rules.linked.items():
        df = X.suppress_linked(df, trigger, measures, least)
    df = X.suppress(df, rules.counts, least)
    if rules.secondary:
        block, n = rules.secondary
        df = X.suppress_secondary(df, block, n, f"{n}_status")
        shown = F.col(f"{n}_status") == "visible"
        df = df.withColumns({c: F.when(shown, F.col(c)) for c in [n, *rules.counts.get(n, [])]})
    if rules.implied:
        n, percentages = rules.implied
        df = df.withColumns({p: X.implied(F.col(n), F.col(p), least) for p in percentages})
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def safe_scalar(value: Column, least: int = 5, token: str = "<5") -> Column:
    """A single count as text, small ones as the token; what is no number stays."""
    n = value.cast("string").try_cast("double")
    return F.when(X.small(n, least), token).otherwise(value.cast("string"))


def blank_profiles(df: DataFrame, n: str, profile: list[str], least: int = 5) -> DataFrame:
    """df with the profiles of classes of under `least` members as null."""
    return X.suppress_linked(df, n, profile, least)


MANIFEST = "file string, sha256 string, bytes bigint, origin string, counts array<string>"
SUFFIXES = ("csv", "json", "tex", "pdf", "md", "txt", "svg", "png")
MOST_BYTES = 25 * 1024 * 1024


def _files(spark: SparkSession, root: str, most: int = MOST_BYTES, content: bool = False) -> DataFrame:
    """file (relative), bytes, and content, which is read of files within the limit only."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.col("path"), "^.*" + re.escape("/" + root.rstrip("/").rpartition("/")[2] + "/"), "")
    d = d.where(~F.startswith(name, F.lit("manifest/")))
    d = d.where(F.col("length") <= most) if content else d
    return d.select(name.alias("file"), F.col("length").alias("bytes"), *(["content"] if content else []))


#: Of one file of a table: rows of up to 500 bytes stay within MOST_BYTES.
MOST_ROWS = 50_000


def write_release(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, Rules]], least: int = 5, token: str = "<5") -> None:
    """The protected tables as CSV under root/tables/<name>/, hidden counts as the token, and root/manifest with the digest of every file, the release's name and each table's person counts. Tables are written in as many parts as they have, and of at most MOST_ROWS rows."""
    for name, (df, rules) in tables.items():
        d = protect(df, rules, least)
        shown = [F.coalesce(F.col(c).cast("string"), F.lit(token)).alias(c) if c in rules.counts else F.col(c) for c in df.columns]
        d.select(*shown).write.option("maxRecordsPerFile", MOST_ROWS).csv(f"{root}/tables/{name}", header=True)
    counts = F.create_map(*[x for name, (_, rules) in tables.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in rules.counts]))])
    listed = _files(spark, root, content=True)
    table = F.element_at(F.split("file", "/"), -2)
    listed = listed.select("file", F.sha2("content", 256).alias("sha256"), "bytes", F.lit(root.rstrip("/").rpartition("/")[2]).alias("origin"), F.try_element_at(counts, table).alias("counts"))
    listed.write.json(f"{root}/manifest")


def _content_faults(name: str, content: bytes, counts: list[str], columns: set[str], patterns: list[str], least: int) -> Iterator[tuple[str, str]]:
    """(rule, detail) of one file of text."""
    text, kind, day = content.decode("utf-8", "replace"), name.rpartition(".")[2].lower(), re.compile(r"\d{4}-\d{2}-\d{2}")
    for p in patterns:
        if re.search(p, text):
            yield "pattern", p

    def small(v) -> bool:
        try:
            return 0 < float(v) < least
        except (TypeError, ValueError):
            return False

    def walk(x, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                if k in columns:
                    yield "key", f"{path}.{k}"
                if isinstance(v, str) and day.match(v) and not k.endswith("_utc"):
                    yield "day", f"{path}.{k}"
                if k in counts and small(v):
                    yield "small_count", f"{path}.{k}={v}"
                yield from walk(v, f"{path}.{k}")
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")

    if kind == "csv":
        rows = csv.DictReader(io.StringIO(text, newline=""))
        yield from (("column", c) for c in sorted(columns & set(rows.fieldnames or [])))
        for line, row in enumerate(rows, 2):
            for c, v in row.items():
                if c in counts and small(v):
                    yield "small_count", f"{line}: {c}={v}"
                if isinstance(v, str) and day.match(v):
                    yield "day", f"{line}: {c}"
    elif kind == "json":
        try:
            yield from walk(json.loads(text), "$")
        except json.JSONDecodeError as e:
            yield "json", str(e)


def verify_release(spark: SparkSession, root: str, columns: list[str], patterns: list[str], least: int = 5, most: int = MOST_BYTES) -> DataFrame:
    """rule, file, detail: everything that must not be in a release's folder; no row if all is well.

    The manifest is joined to the digests of the files (missing, changed, unlisted,
    another release's), kinds and sizes of files are checked, and the text of each
    file within the size limit for forbidden columns, keys and patterns, small person
    counts, dates to the day and broken JSON. A file is one row of one task; files
    over the limit are told by their size and never read.
    """
    out = "rule string, file string, detail string"
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException:
        manifest = None
    try:
        every, read = _files(spark, root), _files(spark, root, most, content=True)
    except AnalysisException:
        return spark.createDataFrame([("no_release", "", root)], out)
    row = lambda rule, detail: [F.lit(rule).alias("rule"), "file", detail.cast("string").alias("detail")]
    suffix = F.lower(F.element_at(F.split("file", r"\."), -1))
    found = every.where(~suffix.isin(*SUFFIXES)).select(*row("type", suffix))
    found = found.unionByName(every.where(F.col("bytes") > most).select(*row("size", F.col("bytes"))))
    if manifest is None:
        found = found.unionByName(spark.createDataFrame([("no_manifest", "manifest", "")], out))
        listed = spark.createDataFrame([], MANIFEST)
    else:
        listed = manifest
        name = root.rstrip("/").rpartition("/")[2]
        found = found.unionByName(listed.where(F.col("origin") != name).groupBy("origin").agg(F.min("file").alias("file")).select(*row("origin", F.col("origin"))))
        found = found.unionByName(listed.join(every, "file", "left_anti").select(*row("missing", F.lit(""))))
        found = found.unionByName(every.join(listed, "file", "left_anti").select(*row("unlisted", F.lit(""))))
        now = read.select("file", F.sha2("content", 256).alias("now"))
        found = found.unionByName(listed.join(now, "file").where("sha256 <> now").select(*row("changed", F.lit(""))))
    forbidden = set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content, counts in zip(*(b.column(c).to_pylist() for c in ("file", "content", "counts")), strict=True):
                rows += [(rule, name, detail) for rule, detail in _content_faults(name, content, counts or [], forbidden, patterns, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["rule", "file", "detail"])

    texts = read.where(suffix.isin("csv", "json", "tex", "md", "txt", "svg")).join(listed.select("file", "counts"), "file", "left").select("file", "content", "counts")
    return found.unionByName(texts.mapInArrow(run, out))


def by_table(found: DataFrame) -> DataFrame:
    """rule, table, n of verify_release(): the parts of one table share its header and its place in the release, so a forbidden column, or that the table isn't listed, is one fault of all its parts; other faults count one by one."""
    table = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.col("file"))
    whole = F.when(F.col("rule") == "column", F.col("detail")).when(F.col("rule") == "unlisted", F.lit(""))
    d = found.groupBy("rule", table.alias("table"), whole.alias("_whole")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("rule", "table").agg(F.sum(F.when(F.col("_whole").isNotNull(), 1).otherwise(F.col("n"))).alias("n"))


INDEX = "key string, number int, settings string, tables array<string>"


def _index(spark: SparkSession, root: str) -> list:
    try:
        return spark.read.schema(INDEX).json(f"{root}/index").orderBy("number").collect()  # one row a run
    except AnalysisException:
        return []


def kept_results(spark: SparkSession, root: str, inputs: list[str], settings: dict, make: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The tables that make() gives, from the folder of an earlier run with the same inputs and settings if there is one, else computed and kept.

    A run's key is a hash of the settings and of the names, sizes and times of the
    input files, of which no content is read. The index's entry is written last,
    so a run that was cut off isn't found.
    """
    seen = []
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        seen.append(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "at").cast("decimal(38,0)"))).first())
    told = json.dumps(settings, sort_keys=True, default=str)
    key = hashlib.sha256(json.dumps([told, [[str(v) for v in r] for r in seen]]).encode()).hexdigest()[:32]
    runs = _index(spark, root)
    if key not in {r.key for r in runs}:
        for name, f in make.items():
            f().write.mode("overwrite").parquet(f"{root}/{key}/{name}")
        spark.createDataFrame([(key, len(runs), told, list(make))], INDEX).write.mode("append").json(f"{root}/index")
    return {name: spark.read.parquet(f"{root}/{key}/{name}") for name in make}


def rebuilt(spark: SparkSession, root: str, settings: dict) -> tuple[dict[str, DataFrame], list[str]]:
    """(the tables of the last run kept, warnings): without any analysis; a warning says where the settings have changed since."""
    runs = _index(spark, root)
    if not runs:
        raise FileNotFoundError(f"no results are kept in {root}")
    last = runs[-1]
    changed = json.loads(last.settings) != json.loads(json.dumps(settings, sort_keys=True, default=str))
    warnings = ["the settings have changed since the results were kept; those of the results count"] if changed else []
    return {name: spark.read.parquet(f"{root}/{last.key}/{name}") for name in last.tables}, warnings


def top_of_groups(df: DataFrame, group: list[str], by: str, top: int) -> DataFrame:
    """df's `top` rows of each group by falling `by`, with their place."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), *[c for c in df.columns if c not in (*group, by)])
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
