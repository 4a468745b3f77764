"""URL rules through a blocked Bloom filter and an exact hash join (operator 2), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import bloom_filter, bloom_holds, bloom_size, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the contract's query applies: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _stem(path: Column) -> Column:
    """A path up to its last slash: what any path that starts with it shares at a slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _key(host: Column, stem: Column) -> Column:
    return F.xxhash64(host, stem)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Every row of pages with host, path, rule and verdict added.

    rules has host, path and verdict. A rule fits its host and all subdomains where
    the url's path starts with the rule's; the longest rule wins (then the first in
    order of text). Rules are listed by (host, path up to its last slash). For each
    distinct url all (host suffix, path up to a slash) pairs, no deeper than the
    deepest rule, are looked up in a blocked Bloom filter of listed pairs; the hits
    go to an exact join, which removes false positives, and back to the pages by
    url. Both joins leave the choice of strategy to Spark, which broadcasts only a
    side it has measured and splits hot urls.

    A null url, or one without "://", has empty host and path and no rule. No rule:
    rule is null and the verdict `otherwise`. Earlier columns with the names added
    here are replaced. Repeated rows each give a row; empty tables give none.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    listed = rules.select(
        F.col("host").alias("r_host"),
        F.col("path").alias("r_path"),
        _stem(F.col("path")).alias("r_stem"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict"),
    ).withColumn("h", _key(F.col("r_host"), F.col("r_stem")))
    listed = written(listed.where("r_host is not null and r_path is not null"), "rules")
    n_words = bloom_size(listed.count(), bits_per_row=16, least=1 << 10)
    words = bloom_filter(listed.select("h"), "h", n_words)
    depth = written(listed.agg(F.coalesce(F.max(F.size(F.split("r_stem", "/"))), F.lit(1)).alias("d"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("l")), "depth")

    urls = pages.where("host <> ''").select(F.col(url_col).alias("_url"), "host", "path").distinct()
    urls = urls.withColumns({"max_labels": depth.select("l").scalar(), "max_steps": depth.select("d").scalar()})
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    n_labels, n_steps = F.size(labels), F.size(steps)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n_labels, F.col("max_labels"))), lambda k: F.concat_ws(".", F.slice(labels, n_labels - k + 1, k))
    )
    stems = F.transform(
        F.sequence(F.lit(0), F.least(n_steps, F.col("max_steps")) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(steps, 1, k)), F.lit("/")))
    )
    probes = urls.select("_url", "path", F.explode(suffixes).alias("p_host"), stems.alias("stems")).select("_url", "path", "p_host", F.explode("stems").alias("p_stem"))
    probes = probes.withColumn("h", _key(F.col("p_host"), F.col("p_stem"))).where(bloom_holds(words, F.col("h"), n_words))
    fits = probes.join(listed, "h").where("p_host = r_host and p_stem = r_stem and startswith(path, r_path)")
    best = fits.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    best = written(best, "verdicts").select("_url", "best.rule", "best.verdict")
    return pages.join(best, F.col(url_col) == F.col("_url"), "left").select(*pages.columns, "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
