"""Linking reports to lots: equality, order-blind keys, similarity, and choice among several."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglot.sources.files import stored


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table in one number's bits."""
    at: dict[str, int] = {}
    for i, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _indel(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([200.0 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)])


_indel.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def ratio(a: str, b: str) -> Column:
    """The normalised Indel ratio of two columns of text, 0 to 100."""
    return F.pandas_udf(_indel, "double")(a, b)


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 85.0, margin: float = 3.0) -> DataFrame:
    """a, b, ratio: for each distinct a the b with the best normalised Indel ratio, if it reaches the threshold and leads the next by the margin.

    If at most d characters have to be put in or taken out, two strings differ in at
    most 2 d of their pairs of neighbouring characters, so the 2 d + 1 rarest pairs of
    one hold one of the other's: only under these the strings meet. Candidates lie in
    the band of lengths that the ratio allows; the edit distance, which never exceeds
    the Indel distance, prunes before the exact ratio is computed. Strings too short to
    share a pair aren't matched.
    """
    ks = left.select(F.col(a).alias("s"), F.lit(True).alias("ask")).where("length(s) > 0").distinct()
    cs = right.select(F.col(b).alias("s"), F.lit(False).alias("ask")).where("length(s) > 0").distinct()
    padded = F.concat(F.lit("^"), F.col("s"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substr(padded, i, F.lit(2))))
    every = ks.unionByName(cs).select("s", "ask", F.explode(grams).alias("g"))
    rare = every.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    t = (threshold - margin) / 100
    most = F.floor((1 - t) * F.length("s") * (1 + (2 - t) / t) + 1e-9).cast("int")  # d, for the longest partner
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("often", "g"))), lambda x: x["g"])
    kept = every.join(rare, "g").groupBy("s", "ask").agg(by_rank.alias("gs")).select("s", "ask", F.explode(F.slice("gs", F.lit(1), 2 * most + 1)).alias("g"))
    side = lambda asks, name: kept.where("ask" if asks else "not ask").select(F.col("s").alias(name), "g")
    pairs = side(True, "a").join(side(False, "b"), "g").select("a", "b").distinct()
    total = F.length("a") + F.length("b")
    near = pairs.where((200.0 * F.least(F.length("a"), F.length("b")) / total >= threshold - margin) & (F.levenshtein("a", "b") <= total * (1 - (threshold - margin) / 100)))
    scored = near.withColumn("ratio", F.pandas_udf(_indel, "double")("a", "b"))
    w = Window.partitionBy("a").orderBy(F.desc("ratio"), "b")
    ranked = scored.withColumns({"place": F.row_number().over(w), "next": F.lead("ratio").over(w)})
    return ranked.where(f"place = 1 and ratio >= {threshold} and (next is null or ratio - next >= {margin})").select("a", "b", "ratio")


def choose(candidates: DataFrame, key: list[str], lot: str, national: str, year: str, report_year: str) -> DataFrame:
    """key, lot, level: of several candidate lots the national ones if any, then those not released after the report if any, then the latest; a tie is ambiguous."""
    w = Window.partitionBy(*key)
    d = candidates.select(*key, lot, national, year, report_year).distinct()
    d = d.withColumn("_any", F.max(F.col(national).cast("int")).over(w)).where(f"_any = 0 or {national}")
    d = d.withColumn("_past", (F.col(year) <= F.col(report_year)).cast("int")).withColumn("_anyp", F.max("_past").over(w)).where("_anyp = 0 or _past = 1")
    d = d.withColumn("_last", F.max(year).over(w)).where(f"{year} = _last")
    out = d.groupBy(*key).agg(F.countDistinct(lot).alias("_n"), F.min(lot).alias(lot))
    return out.select(*key, F.when(F.col("_n") == 1, F.col(lot)).alias(lot), F.when(F.col("_n") == 1, "unique").otherwise("ambiguous").alias("choice"))


def cascade(tokens: DataFrame, lots: DataFrame, record: str = "record_id", threshold: float = 85.0, margin: float = 3.0) -> DataFrame:
    """record, lot_key, level: each token by its exact key, else by its core key, else by similarity; all tokens of a record must agree on one lot.

    tokens(record, exact, core, report_year); lots(lot_key, exact, core, national, year). Ambiguity at a level ends the cascade for the token.
    What a token finds depends on its keys and year alone, so each distinct one is looked up once and the answers go back to the tokens.
    """
    key = ["exact", "core", "report_year"]
    lot = lots.select("lot_key", F.col("exact").alias("l_exact"), F.col("core").alias("l_core"), "national", "year")
    lot, asked = stored(lot), stored(tokens.select(*key).where("exact is not null").distinct())
    answers, rest = None, asked
    for step, on in enumerate(("exact", "core", "similar")):
        if on == "similar":
            like = fuzzy_join(rest, lots, "exact", "exact", threshold, margin).select(F.col("a").alias("exact"), F.col("b").alias("l_exact"))
            met = rest.join(like, "exact").join(lot, "l_exact")
        else:
            met = rest.join(lot, F.col(on) == F.col(f"l_{on}"))
        found = stored(choose(met, key, "lot_key", "national", "year", "report_year").withColumn("step", F.lit(step)))
        answers = found if answers is None else answers.unionByName(found)
        rest = rest.join(found.select(*key), key, "left_anti")
    every = tokens.join(answers, key, "left")
    found = F.when(F.col("lot_key").isNotNull(), F.col("step"))
    out = every.groupBy(record).agg(F.countDistinct("lot_key").alias("n"), F.min("lot_key").alias("lot_key"), F.min(found).alias("best"), F.bool_or(F.col("choice") == "ambiguous").alias("amb"))
    names = F.array(*[F.lit(x) for x in ("exact", "core", "fuzzy")])
    level = F.when(F.col("n") > 1, "multiple_lots").when(F.col("n") == 1, F.get(names, F.col("best"))).when(F.col("amb"), "ambiguous").otherwise("no_match")
    return out.select(record, F.when(F.col("n") == 1, F.col("lot_key")).alias("lot_key"), level.alias("level"))


def release_year(digits: Column, reference: Column, modulus: int) -> Column:
    """The latest year not after the reference whose last digits are these."""
    return reference - F.pmod(reference - digits, F.lit(modulus))


def lot_status(year: Column, released: Column, shelf: int) -> Column:
    return F.when(year.isNull() | released.isNull(), "not_assessable").when(year < released, "before_release").when(year > released + shelf, "expired").otherwise("valid")
