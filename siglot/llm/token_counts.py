"""Token counts of whole texts (operator 1)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, kept, tidy
from siglot.llm.pieces import KEEP, LONG, unsafe


class BatchCounter:
    """Token counts of texts: pieces that a process hasn't met yet go to the library in one batch, and only lengths are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole, self.known = unsafe(), {}

    def batch(self, texts: list[str]) -> list[int]:
        cut = []
        for t in texts:
            if self.whole(t):
                cut.append([t])
            else:
                head, *rest = t.split(" ")
                cut.append([head, *[" " + p for p in rest]])
        if len(self.known) > KEEP:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known)) if cut else []
        lengths = map(len, self.tok.encode_batch_fast(new, add_special_tokens=False))
        self.known.update(zip(new, lengths, strict=True))
        out = [sum(map(self.known.__getitem__, ps)) for ps in cut]
        for p in new:
            if len(p) > LONG:
                del self.known[p]
        return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a byte-level BPE file of the tokenizers library, no
    special tokens are added. Nothing shuffles: each task reads Arrow batches, cuts
    them into slices of equal bytes, splits texts at boundaries where the encoding
    can't change, encodes the pieces that a process hasn't met yet as one batch and
    gives back lengths only. A null text counts as empty (0 bytes, 0 tokens), a null id stays
    null, repeated rows each give a row, other columns aren't read, and an empty
    table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = None
        for b in by_bytes(batches, "_text"):
            encoder = encoder or kept((tokenizer, "counts"), lambda: BatchCounter(tokenizer))
            texts = pc.fill_null(b.column("_text"), "")
            n = encoder.batch(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(count, remembers=True), f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
