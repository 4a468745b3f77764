"""Removal of repeated substrings by suffix arrays (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import bloom_filter, bloom_holds, bloom_size, by_bytes, text_hash, tidy, written

GRAM = 32  # bytes of an anchor
CHUNK = 1 << 22  # starts looked at in one go
SORTED = 1_500_000  # bytes of segments sorted in one go
KEYED = 8_000_000  # bytes of sort keys held at a time
BLOCKS = (16, 1)  # windows of a segment's parts, where segments of one anchor are more than SORTED bytes

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(b: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes, from prefix sums of a polynomial."""
    n = len(b)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = np.uint64(base)
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    return _mix((sums[size:] - sums[: n - size + 1]) * np.cumprod(inverse)[: n - size + 1])


def anchors(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, hash) of the runs of windows of `width` bytes with one anchor: the leftmost gram of least hash inside the window. It depends on the window's bytes alone, so equal windows have equal anchors wherever they stand."""
    h = rolling(b, GRAM, BASES[0])
    w, m = width - GRAM + 1, len(b) - width + 1
    low = np.uint64((1 << 23) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(h) // w) * w
    blocks = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[: len(h)] = packed
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], m) - 1, h[at[first]]


def _direct(text: bytes, value: np.ndarray, end_of: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """seeds in the order of the `width` bytes that begin there (less where the piece ends).

    Positions are sorted, not copies of bytes: by seven bytes at a time as one number,
    ties by the next seven. Ties whose remaining bytes come to KEYED at most are put
    in order by comparing these bytes.
    """
    out, todo = seeds.copy(), [(0, len(seeds), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if depth >= width:
            continue
        group, ends = out[lo:hi], end_of[out[lo:hi]]
        if (hi - lo) * (width - depth) <= KEYED and (depth or hi - lo < 1000):
            keys = [text[p + depth : min(p + width, e)] for p, e in zip(group.tolist(), ends.tolist(), strict=True)]
            out[lo:hi] = group[sorted(range(hi - lo), key=keys.__getitem__)]
            continue
        word = np.zeros(hi - lo, np.int64)
        for i in range(depth, depth + 7):
            p = np.minimum(group + i, len(text))
            word = word << 9 | np.where(p < ends, value[p], 0)
        order = np.argsort(word, kind="stable")
        word = word[order]
        out[lo:hi] = group[order]
        cuts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [hi - lo]])
        many = np.flatnonzero(np.diff(cuts) > 1)  # only ties go on
        todo += [(lo + a, lo + b, depth + 7) for a, b in zip(cuts[many].tolist(), cuts[many + 1].tolist(), strict=True)]
    return out


def sorted_starts(text: bytes, pieces: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """The starts of the pieces (first byte, end, number of starts) in the order of the suffixes that begin there, by two-stage sorting to a depth of `width` bytes at least.

    A suffix smaller than its successor is sorted directly. The others are put in
    place by a scan over the buckets of first bytes: whatever stands in order in a
    bucket brings the suffix that begins one byte before it to the next free place of
    that one's bucket. Suffixes end with their piece, and the empty one comes first.
    """
    n = len(text)
    value = np.zeros(n + 1, np.int16)
    value[:n] = np.frombuffer(text, np.uint8)
    value[:n] += 1
    ends = np.array([e for _, e, _ in pieces])
    # smaller than its successor: the next different byte within the piece is larger; a piece's last bytes are larger than the empty suffix
    differs = np.flatnonzero(value[:n] != value[1 : n + 1])
    stop = np.minimum(np.append(differs, n)[np.searchsorted(differs, np.arange(n))], n - 1)
    end_of = ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends
    direct = (stop + 1 < end_of) & (value[np.minimum(stop + 1, n)] > value[stop])
    included = np.zeros(n + 1, bool)
    for a, e, m in pieces:
        included[a : a + m] = True
        last = a + m - 1
        while last < e and not direct[last]:  # what the last starts are induced from
            included[last] = True
            last += 1
        if last < e:
            included[last] = True
    larger = np.zeros(n + 1, bool)
    larger[:n] = ~direct & included[:n]
    seeds = _direct(text, value, end_of, np.flatnonzero(direct & included[:n]), width)
    fixed = np.split(seeds, np.searchsorted(value[seeds], np.arange(1, 257)))  # value[seeds] ascends
    front: list[list[np.ndarray]] = [[] for _ in range(257)]

    def spread(places: np.ndarray, above: int) -> None:
        if len(places):
            v = value[places]
            order = np.argsort(v, kind="stable")
            places, v = places[order], v[order]
            cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            for part, c in zip(np.split(places, cuts[1:]), v[cuts].tolist(), strict=True):
                front[c].append(part)

    tails = ends - 1  # brought by the empty suffixes
    spread(tails[larger[tails]], 0)
    out = []
    starts_piece = np.zeros(n + 1, bool)
    starts_piece[[a for a, _, _ in pieces]] = True
    for c in range(1, 257):
        run = np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)
        runs = [run]
        while len(run):
            before = run[~starts_piece[run]] - 1
            before = before[larger[before]]
            run = before[value[before] == c]
            runs.append(run)
        here = np.concatenate([*runs, fixed[c]]) if len(fixed) > c else np.concatenate(runs)
        out.append(here)
        before = here[~starts_piece[here]] - 1
        before = before[larger[before]]
        spread(before[value[before] > c], c)
    order = np.concatenate(out)
    real = np.zeros(n + 1, bool)
    for a, _, m in pieces:
        real[a : a + m] = True
    return order[real[order]]


def repeated_starts(text: bytes, pieces: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """A mark for each byte of text: whether a start there has a neighbour in suffix order with `width` equal bytes at least."""
    order = sorted_starts(text, pieces, width)
    mark = np.zeros(len(text), bool)
    a, b = order[:-1], order[1:]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(64), np.uint8), 50)
    for at in range(0, width, 50):  # common prefixes, as far as they matter
        k = min(50, width - at)
        keep = np.concatenate([(view[a[i : i + 50_000] + at, :k] == view[b[i : i + 50_000] + at, :k]).all(axis=1) for i in range(0, len(a), 50_000)]) if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
    mark[a] = True
    mark[b] = True
    return mark


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))


def _digest(x: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(x)


SPAN = "tid binary, a bigint, b bigint, anchor bigint, part binary, n bigint, bytes bigint"


def _spans(docs: DataFrame, width: int) -> DataFrame:
    """tid, a, b (first and last start), anchor, part (128-bit hash of the bytes a to b + width), n (1), bytes (their number): each text as runs of starts with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text"):
            out: list[list] = [[], [], [], []]
            tids, parts = [], []
            for tid, t in zip(batch.column("_tid").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                raw = t.encode("utf-8") if t else b""
                for c in range(0, len(raw) - width + 1, CHUNK):
                    piece = raw[c : c + CHUNK + width - 1]
                    a, b, h = anchors(np.frombuffer(piece, np.uint8), width)
                    tids += [tid] * len(a)
                    parts += [_digest(piece[x : y + width]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    for o, x in zip(out, (a + c, b + c, h.view(np.int64), b - a + width), strict=True):
                        o.append(x)
            if tids:
                a, b, h, size = map(np.concatenate, out)
                yield _batch(tid=pa.array(tids, pa.binary()), a=a, b=b, anchor=h, part=pa.array(parts, pa.binary()), n=np.ones(len(a), np.int64), bytes=size)

    return docs.where(F.octet_length("_text") >= width).select("_tid", "_text").mapInArrow(tidy(run), SPAN)


def _parts(cut: DataFrame, width: int, block: int) -> DataFrame:
    """Spans of one anchor in parts of up to `block` windows, by where the windows stand to the anchor.

    Two equal windows hold their anchor at one place, so they fall into parts of one
    number, and these parts share the bytes that all windows of such a part hold:
    the hash of anchor, number and shared bytes is the anchor of the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "raw", 200_000):
            rows = []
            for tid, a, b, anchor, gram, n, raw in zip(*(batch.column(c).to_pylist() for c in ("tid", "a", "b", "anchor", "gram", "n", "raw")), strict=True):
                at = a
                while at <= b:
                    number = (gram - at) // block  # windows from `low` to `high` have their anchor at one place, give or take block
                    low, high = gram - number * block - block + 1, gram - number * block
                    end = min(b, high)
                    core = raw[high - a : low - a + width]
                    piece = raw[at - a : end - a + width]
                    key = int.from_bytes(_digest(b"%d %d " % (anchor, number) + core)[:8], "little", signed=True)
                    rows.append((tid, at, end, key, _digest(piece), n, len(piece)))
                    at = end + 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield _batch(**{k: pa.array(c, t) for k, c, t in zip(("tid", "a", "b", "anchor", "part", "n", "bytes"), cols, kinds, strict=True)})

    return cut.mapInArrow(tidy(run), SPAN)


def _cut(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted spans (tid, a, b, ...), each text fetched once: wanted's columns, raw (the bytes) and gram (where the anchor stands)."""
    n_words = bloom_size(wanted.count())
    among = bloom_filter(wanted.select(F.xxhash64("tid").alias("h")), "h", n_words)
    texts = docs.where(bloom_holds(among, F.xxhash64("_tid"), n_words)).groupBy("_tid").agg(F.min("_text").alias("_text"))
    spans = wanted.groupBy("tid").agg(F.collect_list(F.struct("a", "b", "anchor", "n", "many")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text", 1_000_000):
            for tid, t, spans in zip(batch.column("tid").to_pylist(), batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = t.encode("utf-8")
                for i in range(0, len(spans), 2_000):
                    s = spans[i : i + 2_000]
                    cols = {k: pa.array([x[k] for x in s], pa.int64()) for k in ("a", "b", "anchor", "n")}
                    raw = [text[x["a"] : x["b"] + width] for x in s]
                    gram = [x["a"] + _least_gram(r, x["b"] - x["a"]) for x, r in zip(s, raw, strict=True)]
                    yield _batch(tid=pa.array([tid] * len(s), pa.binary()), **cols, many=pa.array([x["many"] for x in s]), gram=pa.array(gram, pa.int64()), raw=pa.array(raw, pa.binary()))

    return spans.join(texts, F.col("tid") == F.col("_tid")).select("tid", "_text", "spans").mapInArrow(tidy(run), "tid binary, a bigint, b bigint, anchor bigint, n bigint, many boolean, gram bigint, raw binary")


def _least_gram(raw: bytes, last: int) -> int:
    """Where in a span's bytes its anchor stands: the leftmost gram of least hash (as anchors() takes it) in what all its windows hold."""
    inner = np.frombuffer(raw[last : len(raw) - last], np.uint8)
    h = rolling(inner, GRAM, BASES[0])
    return last + int(np.argmin(h & ~np.uint64((1 << 23) - 1)))


def _by_suffixes(cut: DataFrame, width: int) -> DataFrame:
    """tid, a, b: starts of single spans whose windows stand in another span too. Spans of one anchor meet in one task, which sorts a bounded lot of whole anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            text, pieces, at = b"".join([x[4] for x in lot]), [], 0
            for _, a, b, _, raw in lot:
                pieces.append((at, at + len(raw), b - a + 1))
                at += len(raw)
            mark = repeated_starts(text, pieces, width)
            tids: list[bytes] = []
            out: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for (tid, a, _, n, _), (p, _, m) in zip(lot, pieces, strict=True):
                if n == 1 and mark[p : p + m].any():
                    x, y = _runs(mark[p : p + m])
                    tids += [tid] * len(x)
                    out[0].append(x + a)
                    out[1].append(y + a)
            return _batch(tid=pa.array(tids, pa.binary()), a=np.concatenate(out[0]), b=np.concatenate(out[1]))

        for batch in batches:
            for tid, a, b, anchor, n, raw in zip(*(batch.column(c).to_pylist() for c in ("tid", "a", "b", "anchor", "n", "raw")), strict=True):
                if anchor != last and size > SORTED:
                    yield done()
                    lot, size = [], 0
                last = anchor
                lot.append((tid, a, b, n, raw))
                size += len(raw)
        if lot:
            yield done()

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(parts, "anchor").sortWithinPartitions("anchor").select("tid", "a", "b", "anchor", "n", "raw").mapInArrow(tidy(run), "tid binary, a bigint, b bigint")


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """_tid, spans array<struct<a,b>>: for each text with some, the runs of starts whose `width` bytes also start elsewhere in docs(_tid, _text).

    Each window of `width` bytes has an anchor that its own bytes choose, and a text
    falls into spans of starts with one anchor. A span with equal bytes elsewhere is
    repeated as a whole. Only anchors that different spans share need the order of
    their suffixes: these spans' bytes, one copy of each, go by anchor to the suffix
    sort. Where different spans of one anchor come to more than SORTED bytes, they are
    taken apart by the windows' place to the anchor and by what all windows of a part
    share, and the same is done with the parts. A part of one window shares all of it
    with its like, so this ends, and no group of unbounded size meets in a task.
    """
    spans, found, kinds = written(_spans(docs, width), "spans"), None, None
    for block in (*BLOCKS, None):
        met = spans.groupBy("anchor").agg(F.sum("n").alias("k"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("k > 1")
        met = written(met.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
        near = written(spans.join(met, "anchor"), "near")
        kinds = near.groupBy("anchor", "part").agg(F.sum("n").alias("n"), F.min(F.struct("tid", "a", "b", "bytes")).alias("one"), F.first("mixed").alias("mixed"))
        kinds = written(kinds, "kinds")
        whole = written(kinds.where("n > 1").select("anchor", "part"), "whole")
        copied = near.join(whole, ["anchor", "part"], "left_semi").select("tid", "a", "b").dropDuplicates()  # equal texts have one tid: once per text, not per row
        found = copied if found is None else found.unionByName(copied)
        mixed = kinds.where("mixed")
        crowd = written(mixed.groupBy("anchor").agg(F.sum("one.bytes").alias("size")).select("anchor", (F.col("size") > SORTED).alias("many")), "crowds")
        wanted = mixed.join(crowd, "anchor").select("anchor", "n", "one.*", "many" if block else F.lit(False).alias("many"))
        wanted = written(wanted, "wanted")
        cut = written(_cut(docs, wanted, width), "cut")
        found = found.unionByName(_by_suffixes(cut.where("not many"), width))
        if not wanted.where("many").limit(1).count():
            break
        spans = written(_parts(cut.where("many"), width, block), "spans")
    return written(found.groupBy(F.col("tid").alias("_tid")).agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeated")


def suffix_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, and with_kept also kept (the bytes that remain): one row per row of docs.

    A byte goes if it lies in `width` bytes that also start anywhere else, in the
    same text or another. Rows that repeat a text are elsewhere for each other. Texts
    shorter than width, empty and null ones lose nothing. Null ids stay null; other
    columns aren't read; an empty table gives no rows. Only texts that lose
    something are shuffled whole.
    """
    docs = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_tid"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marks = repeated_spans(docs.select("_tid", "_text"), width)
    n_words = bloom_size(marks.count())
    holds = bloom_holds(bloom_filter(marks.select(F.xxhash64("_tid").alias("h")), "h", n_words), F.xxhash64("_tid"), n_words)
    kind = docs.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text"):
            n, gone, runs, sha, kept = [], [], [], [], []
            for t, spans in zip(b.column("_text").to_pylist(), b.column("spans"), strict=True):
                raw = t.encode("utf-8")
                edge = np.zeros(len(raw) + 1, np.int32)
                if spans.is_valid:
                    s = spans.values
                    np.add.at(edge, pc.struct_field(s, "a").to_numpy(), 1)
                    np.add.at(edge, pc.struct_field(s, "b").to_numpy() + width, -1)
                out = np.cumsum(edge[:-1]) > 0
                rest = np.frombuffer(raw, np.uint8)[~out].tobytes()
                n.append(len(raw))
                gone.append(int(out.sum()))
                runs.append(len(_runs(out)[0]))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = {"_id": b.column("_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield _batch(**cols, **({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    schema = f"_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    some = docs.where(holds).join(marks, "_tid", "left").select("_id", "_text", "spans").mapInArrow(tidy(cut), schema)
    none = docs.where(~holds).select("_id", F.octet_length("_text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"), *([F.col("_text").cast("binary").alias("kept")] if with_kept else []))
    return some.unionByName(none).withColumnRenamed("_id", id_col)
