"""Helpers that the training-text operators share: shared storage, Bloom filters, byte-bounded batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only a local master may leave unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not base:
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-siglot-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, most_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and lost executors cost nothing. most_rows bounds the Arrow batches of this one job, where rows are whole texts."""
    spark, path, name = df.sparkSession, new_path(df.sparkSession, tag), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if most_rows:
        spark.conf.set(name, str(most_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever its columns are called."""
    taken, k = {c.lower() for c in df.columns}, 0
    while f"_{name}_{k}" in taken:
        k += 1
    return f"_{name}_{k}"


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bloom_size(rows: int, bits_per_row: int = 16, least: int = 1 << 12, most: int = 1 << 20) -> int:
    """64-bit words for a filter of rows keys: a power of two, never over most (8 MB), whatever the input."""
    words = least
    while words * 64 < rows * bits_per_row and words < most:
        words *= 2
    return words


def bloom_word(h: Column, n_words: int) -> Column:
    """The block of hash h: one 64-bit word."""
    return h.bitwiseAND(F.lit(n_words - 1)).cast("int")


def bloom_mask(h: Column) -> Column:
    """Four bits inside the block, from the upper bits of h."""
    one = F.lit(1).cast("bigint")
    bits = [F.expr("0L")]
    for shift in (40, 46, 52, 58):
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        bits.append(F.call_function("shiftleft", one, at))
    out = bits[1]
    for b in bits[2:]:
        out = out.bitwiseOR(b)
    return out


def _dense(spark: SparkSession, words: DataFrame, n_words: int, tag: str) -> Column:
    """words(word int, mask bigint) as one array of n_words longs, held in shared storage and read as a scalar subquery."""
    chunk = 1024
    every = spark.range(n_words).select(F.col("id").cast("int").alias("word"), F.expr("0L").alias("mask"))
    blocks = (
        words.unionByName(every)
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .groupBy(F.floor(F.col("word") / chunk).cast("int").alias("block"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("masks"))
    )
    blocks = written(blocks, tag)
    one = blocks.agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "masks"))), lambda x: x["masks"])).alias("w")
    )
    return written(one, tag).select("w").scalar()


def bloom_filter(keys: DataFrame, h: str, n_words: int, tag: str = "bloom") -> Column:
    """A blocked Bloom filter over the bigint hashes in keys[h], as a Column of n_words longs."""
    words = keys.select(bloom_word(F.col(h), n_words).alias("word"), bloom_mask(F.col(h)).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return _dense(keys.sparkSession, words, n_words, tag)


def bloom_holds(words: Column, h: Column, n_words: int) -> Column:
    """False only for hashes that are surely absent."""
    mask = bloom_mask(h)
    return F.coalesce(F.get(words, bloom_word(h, n_words)).bitwiseAND(mask) == mask, F.lit(False))


def without(docs: DataFrame, bad: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose key is in bad.h, a stored table. A Bloom filter of these keys lets rows outside it pass straight through, whole and unmoved; only the few that it holds are joined."""
    n_words = bloom_size(bad.count())
    held = bloom_holds(bloom_filter(bad.select(F.xxhash64("h").alias("k")), "k", n_words), F.xxhash64(key), n_words)
    name = fresh(docs, "bad")
    maybe = docs.where(held).join(bad.select(F.col("h").alias(name)), key == F.col(name), "left_anti")
    return docs.where(~held).unionByName(maybe)


def slot_filter(slots: DataFrame, n_words: int, tag: str = "slots") -> Column:
    """A bitmap of the bit numbers in slots.slot (0 to 64 * n_words - 1)."""
    words = (
        slots.select(
            F.shiftright("slot", 6).cast("int").alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("mask"),
        )
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    return _dense(slots.sparkSession, words, n_words, tag)


def slot_set(words: Column, slot: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return F.get(words, F.shiftright(slot, 6).cast("int")).bitwiseAND(bit) != 0


def _memory() -> dict:
    """What a worker process remembers: in a module of its own, as functions travel to workers by value."""
    module = sys.modules.setdefault("_siglot_memory", types.ModuleType("_siglot_memory"))
    return module.__dict__.setdefault("kept", {})


def kept(name: tuple, make: Callable):
    """What make() gave in this process first, for all tasks that it runs. One thing is remembered at a time."""
    memory = _memory()
    if name not in memory:
        if memory:
            memory.clear()
            _give_back()
        memory[name] = make()
        _give_back()  # what making it took besides
    return memory[name]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(run: Callable, remembers: bool = False) -> Callable:
    """A function of Arrow batches that gives its memory back when its task ends: workers stay for later stages, and what their allocators keep would count against those. Unless it remembers something itself, it drops what another operator's tasks have kept."""

    def tidied(batches: Iterator) -> Iterator:
        if not remembers and _memory():
            _memory().clear()
            _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about `most` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lens):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
