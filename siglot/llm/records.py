"""Token ids as length-delimited binary records with an offset index (operator 9)."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siglot.llm.common import by_bytes, tidy, written
from siglot.llm.pieces import PieceEncoder, two_bytes

# A shard holds records one after the other. A record is
#   length u64 | masked crc of the length u32 | payload | masked crc of the payload u32   (little-endian)
# and its payload is
#   has_id u8 | id i64 | ids u16[]
# A checksum is masked by turning it right by 15 bits and adding a constant, so
# that checksums over data that hold checksums stay useful.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL, LEAD = 12, 4, 9


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked_crc(n)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at offset `at` and the offset after it; ValueError where a checksum fails."""
    n = data[at : at + 8]
    if len(n) < 8 or masked_crc(n) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"damaged length at byte {at}")
    size = struct.unpack("<Q", n)[0]
    payload = data[at + HEAD : at + HEAD + size]
    if len(payload) < size or masked_crc(payload) != struct.unpack_from("<I", data, at + HEAD + size)[0]:
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + HEAD + size + TAIL


def _file(shard: int) -> str:
    return f"shard-{shard:012d}.rec"


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int, parts: int | None = None, most: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes path/data/shard-NNNNNNNNNNNN.rec and the index table path/index; returns the index.

    Shards follow each other in ascending id order (nulls first, equal ids in the
    order of their text's hash), and a shard that has reached `most` bytes is
    followed by another. Each text is encoded, end_id is appended, and the index
    keeps shard, pos, id_col, offset, length and n_tokens of every record. A task
    writes under a name of its own and moves each finished file in place, so a task
    that runs twice leaves one whole shard. Null texts count as empty; other columns
    aren't read; an empty table gives an empty index and no shards. ids must fit 16
    bits.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = f"{path}/data"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, attempt = TaskContext.get().partitionId() << 20, TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(data)
        fs.create_dir(root, recursive=True)
        end = struct.pack("<H", end_id)
        encoder = PieceEncoder.of_process(tokenizer, two_bytes, b"".join)
        temp, f, at, pos = f"{root}/_temp-{shard}-{attempt}", None, 0, 0
        for b in by_bytes(batches, "_text"):
            rows = []
            for i, t in zip(b.column("_id").to_pylist(), pc.fill_null(b.column("_text"), "").to_pylist(), strict=True):
                tokens = b"".join(encoder.text(t)) + end
                r = frame(struct.pack("<Bq", i is not None, i or 0) + tokens)
                if f and at + len(r) > most:
                    f.close()
                    fs.move(temp, f"{root}/{_file(shard)}")
                    f, shard, at, pos = None, shard + 1, 0, 0
                f = f or fs.open_output_stream(temp)
                rows.append((shard, pos, i, at, len(r), len(tokens) // 2))
                f.write(r)
                at, pos = at + len(r), pos + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "pos", "_id", "offset", "length", "n_tokens"])
        if f:
            f.close()
            fs.move(temp, f"{root}/{_file(shard)}")

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
        .repartitionByRange(n, F.col("_id").asc_nulls_first())
        .sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    )
    index = ordered.mapInArrow(tidy(write, remembers=True), "shard bigint, pos int, _id bigint, offset bigint, length bigint, n_tokens bigint")
    index.withColumnRenamed("_id", id_col).write.parquet(f"{path}/index")
    return spark.read.schema(f"shard bigint, pos int, `{id_col}` bigint, offset bigint, length bigint, n_tokens bigint").parquet(f"{path}/index")


def _records(f) -> Iterator[bytes]:
    """The payloads of a shard that is read as a stream, one record at a time; ValueError where a checksum fails."""
    at = 0
    while head := f.read(HEAD):
        if len(head) < HEAD or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError(f"damaged length at byte {at}")
        rest = f.read(struct.unpack("<Q", head[:8])[0] + TAIL)
        payload, at = unframe(head + rest)[0], at + len(head) + len(rest)
        yield payload


def read_records(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Reads every shard back and checks it: shard, pos, id_col, n_tokens, ids_crc32 (of the ids as u32), shard_start (ids of the shard before it). The index says which shards there are; a task streams through a shard record by record."""
    data = f"{path}/data"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(data)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "pos", "_id", "n_tokens", "ids_crc32", "shard_start"])

        for shard in (x for b in batches for x in b.column("shard").to_pylist()):
            rows, start = [], 0
            with fs.open_input_stream(f"{root}/{_file(shard)}", buffer_size=1 << 20) as f:
                for pos, payload in enumerate(_records(f)):
                    has, i = struct.unpack_from("<Bq", payload)
                    ids = np.frombuffer(payload, "<u2", offset=LEAD)
                    rows.append((shard, pos, i if has else None, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), start))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    shards = written(spark.read.parquet(f"{path}/index").select("shard").distinct(), "shards")
    shards = shards.repartition(max(1, shards.count()), "shard")  # a shard is a task's work
    return shards.mapInArrow(tidy(parse), "shard bigint, pos int, _id bigint, n_tokens bigint, ids_crc32 bigint, shard_start bigint").withColumnRenamed("_id", id_col)


def read_some(index: DataFrame, wanted: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The ids of the wanted documents, each fetched by one seek at its offset: id_col, ids array<int>."""
    data = f"{path}/data"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(data)
        for b in batches:
            rows = b.to_pydict()
            ids = []
            for shard, at, n in zip(rows["shard"], rows["offset"], rows["length"], strict=True):
                with fs.open_input_file(f"{root}/{_file(shard)}") as f:
                    f.seek(at)
                    ids.append(np.frombuffer(unframe(f.read(n))[0], "<u2", offset=LEAD).tolist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    rows = index.join(wanted.select(id_col).distinct(), id_col, "left_semi").select(F.col(id_col).alias("_id"), "shard", "offset", "length")
    return rows.mapInArrow(tidy(fetch), "_id bigint, ids array<int>").withColumnRenamed("_id", id_col)


def record_digest(records: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of records read back. The running total runs over shards, a small table; within a shard the reader counted."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("shard"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return records.join(base, "shard").select(id_col, (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
