"""Benchmark decontamination by spaced seeds (operator 8), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import bloom_filter, bloom_holds, bloom_size, fresh, text_hash, without, written

#: Fixed masks: word positions marked 1 are hashed, those marked 0 may differ. Whichever
#: fifth of the words of a window of 8 to 13 words is substituted, one of these masks lies
#: somewhere in the window with all its words unchanged (all cases are tested).
MASKS = ("11111", "111011", "11010011")
LEAST = 8  # words of an item


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(df: DataFrame, words: str, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keep, pos and hash h of every seed of the array column words; h is null where a mask would pass the end."""
    # explode() of one array keeps the optimizer from putting its formula in place of w, once for every position
    least = min(map(len, masks))
    rows = df.select(*keep, F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("w")).where(F.size("w") >= least)
    places = F.sequence(F.lit(0), F.size("w") - least)

    def seed(k: int, mask: str):
        h = lambda i: F.xxhash64(F.lit(k), *[F.get("w", i + o) for o, bit in enumerate(mask) if bit == "1"])
        return h if len(mask) == least else lambda i: F.when(i <= F.size("w") - len(mask), h(i))

    arrays = [F.transform(places, seed(k, mask)) for k, mask in enumerate(masks)]
    rows = rows.select(*keep, (F.size("w") - least + 1).alias("n"), F.concat(*arrays).alias("hs"))
    rows = rows.select(*keep, "n", F.posexplode("hs").alias("at", "h"))
    return rows.select(*keep, F.expr("at % n").alias("pos"), "h")


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 13, agree: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id_col, item_col, start, n_overlap, n_equal, best_window: a row for each document and benchmark item that overlap.

    Seeds of the benchmark are hashed under each mask into a Bloom filter; those of
    the documents that pass it are joined to the benchmark's. A hit
    fixes how item and document lie upon each other; there, all words of the item
    and of the document are compared, and the overlap counts if some stretch of
    `window` words (the whole item, if shorter) has at least `agree` equal ones. With
    the masks and limits given here no such overlap is missed, and a hit alone
    condemns nothing. Of several overlaps with one item the best is returned.

    Items shorter than 8 words, texts shorter than a mask, null and empty ones match
    nothing. Items that repeat an id are items of their own. Equal texts are verified once and give a row for every document row;
    null ids, of documents and of items, are returned as null. Other columns aren't read; empty tables give no
    rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("_item"), F.col(item_col).alias("_item_id"), words_of(F.col(text_col)).alias("item_words"))
    items = written(items.where(F.size("item_words") >= LEAST), "items")
    seeds = written(_seeds(items, "item_words", ["_item"], masks).where("h is not null").withColumnRenamed("pos", "item_pos"), "seeds")
    n_words = bloom_size(seeds.count())
    bits = bloom_filter(seeds.select("h"), "h", n_words)

    rows = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_tid"), F.col(text_col).alias("_text"))
    passed = _seeds(rows.select("_tid", words_of(F.col("_text")).alias("words")), "words", ["_tid"], masks).where(bloom_holds(bits, F.col("h"), n_words))
    hits = passed.join(seeds, "h").groupBy("_tid", "_item", (F.col("pos") - F.col("item_pos")).alias("off")).agg(F.count(F.lit(1)).alias("n_seeds"))
    hits = written(hits, "hits")

    # the texts of the hits only, each once
    hit_words = bloom_size(hits.count())
    among = bloom_filter(hits.select(F.xxhash64("_tid").alias("h")), "h", hit_words)
    texts = rows.where(bloom_holds(among, F.xxhash64("_tid"), hit_words)).groupBy("_tid").agg(F.min("_text").alias("_text"))
    placed = written(hits.join(items.select("_item", F.size("item_words").alias("m")), "_item").groupBy("_tid").agg(F.collect_list(F.struct("_item", "off", "m")).alias("at")), "placed")
    lined = placed.join(texts, "_tid").select("_tid", "at", F.explode(F.array(words_of(F.col("_text")))).alias("words"))
    cut = lambda a: F.struct(  # noqa: E731  the document's words under the item, and the item's first word that has one
        a["_item"].alias("_item"), F.greatest(a["off"], F.lit(0)).alias("start"), F.greatest(-a["off"], F.lit(0)).alias("skip"),
        F.slice("words", F.greatest(a["off"], F.lit(0)) + 1, a["m"] - F.greatest(-a["off"], F.lit(0))).alias("part"),
    )
    parts = lined.select("_tid", F.explode(F.transform("at", cut)).alias("p")).select("_tid", "p.*")
    pairs = parts.join(items.drop("_item_id"), "_item").select("_tid", "_item", "start", "part", F.slice("item_words", F.col("skip") + 1, F.size("part")).alias("same"), F.size("item_words").alias("m"))
    pairs = pairs.select("*", F.explode(F.array(F.zip_with("part", "same", lambda x, y: F.when(x == y, 1).otherwise(0)))).alias("equal"))
    pairs = pairs.withColumn("w", F.least(F.lit(window), F.col("m"))).where(F.size("equal") >= F.col("w"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    pairs = pairs.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("w") + 1), lambda i: total(F.slice("equal", i, F.col("w"))))))
    found = pairs.where(F.col("best") >= F.ceil(F.col("w") * agree)).groupBy("_tid", "_item").agg(
        F.max(F.struct(total(F.col("equal")).alias("n_equal"), F.size("equal").alias("n_overlap"), F.col("best").alias("best_window"), (-F.col("start")).alias("back"))).alias("x")
    )
    found = written(found, "found").select("_tid", "_item", (-F.col("x.back")).alias("start"), "x.n_overlap", "x.n_equal", "x.best_window")
    found = found.join(items.select("_item", "_item_id"), "_item")
    return rows.select("_id", "_tid").join(found, "_tid").select(F.col("_id").alias(id_col), F.col("_item_id").alias(item_col), "start", "n_overlap", "n_equal", "best_window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that overlap with no benchmark item."""
    key = fresh(docs, "key")
    bad = contaminated(docs.select(text_hash(F.col(text_col)).alias(key), F.col(text_col)), benchmark, id_col=key, text_col=text_col, **how)
    bad = written(bad.select(F.col(key).alias("h")).distinct(), "bad")
    return without(docs, bad, text_hash(F.col(text_col)))
