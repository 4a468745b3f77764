"""Exact dedup with a two-pass Bloom filter (operator 6), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import bloom_size, fresh, slot_filter, slot_set, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the
    row with the largest id stays.

    Pass 1 counts, for two slots of each text's hash, how often the slot is taken,
    and keeps the slots taken at least twice in a bitmap of bounded size (8 MB at
    most). Pass 2: a row of which a slot was taken once is surely alone; it passes
    straight through with its text. Only the others are grouped by SHA-256, with
    counts formed before the shuffle, and joined to their group's row. When the
    input outgrows the bitmap more rows take the second way; results stay the same.

    Null ids lose against any other; rows that repeat id and text can't be told
    apart and share one fate; other columns pass through, but for earlier columns
    of the names added here, which are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    text, mark = F.coalesce(F.col(text_col), F.lit("")), fresh(docs, "again")
    n_words = bloom_size(docs.count(), bits_per_row)
    bits = F.lit(64 * n_words - 1)
    h = F.xxhash64(text)
    first, second = h.bitwiseAND(bits), F.shiftrightunsigned(h, 32).bitwiseAND(bits)

    slots = docs.select(F.explode(F.array_distinct(F.array(first, second))).alias("slot")).groupBy("slot").count().where("count > 1")
    words = slot_filter(slots.select("slot"), n_words)
    flagged = docs.withColumns({mark: slot_set(words, first) & slot_set(words, second), "text_sha256": F.sha2(text, 256)})

    again = flagged.where(F.col(mark)).drop(mark)
    groups = again.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "copies")  # a join of two plain shuffles, so that a hot group can be split
    alone = flagged.where(~F.col(mark)).drop(mark).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    joined = again.join(groups, "text_sha256").withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(joined).select(*docs.columns, "keep_id", "group_size", "kept", "text_sha256")
