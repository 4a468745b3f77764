"""Ranked lexical search by branch and bound over document FP-trees (operator 13)."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, tidy, written

#: Bytes of terms, A-Z lower-cased; all others part them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LEAF = 64  # documents of a leaf
LOT = 4_096  # documents of a tree, at most
CELLS = 8_000_000  # of the maxima of one tree, as a goal
PART = 4_000_000  # bytes of a text that are split at a time


def count_terms(text: bytes) -> Counter:
    """How often each term occurs."""
    text, start, seen = text.translate(TERM_BYTES), 0, Counter()
    while start < len(text):
        stop = text.find(b" ", start + PART)
        stop = len(text) if stop < 0 else stop
        seen.update(text[start:stop].split())
        start = stop
    return seen


class DocumentTree:
    """A trie of sorted term vectors, with what bounds the scores under each node.

    vectors are the documents' restricted terms by falling document frequency, as
    big-endian ranks, in ascending order: documents that share their first terms lie
    side by side, and a node is a range of them. Paths without branches are one
    node; ranges of up to LEAF documents are leaves. A node has the greatest
    frequency of every term and the least m under it.
    """

    def __init__(self, vectors: list[bytes], tfs: list[bytes], m: np.ndarray, weight: np.ndarray):
        self.lens = np.array([len(v) // 4 for v in vectors], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.ranks = np.frombuffer(b"".join(vectors), ">u4").astype(np.int64)
        self.tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
        self.m, self.weight = m, weight
        self.gain = weight[self.ranks] * (1_000_000_000 * self.tf // (1000 * self.tf + 12 * np.repeat(m, self.lens)))
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(0, len(vectors))

    def _grow(self, lo: int, hi: int) -> None:
        """The nodes of the documents lo to hi; those below a node come after it."""
        todo = [(lo, hi, None)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(self.ranges)
            self.ranges.append((lo, hi))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if hi - lo > LEAF:
                todo += [(a, b, node) for a, b in reversed(self._branches(lo, hi))]

    def _branches(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges that differ in the first term that not all of lo to hi share; small ones that lie side by side are taken together."""
        first, last = (self.ranks[self.starts[i] : self.starts[i] + self.lens[i]] for i in (lo, hi - 1))
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[:n] != last[:n])
        depth = int(differ[0]) if len(differ) else n  # of sorted vectors, what the first and the last share all share
        has = self.lens[lo:hi] > depth
        term = np.where(has, self.ranks[np.where(has, self.starts[lo:hi] + depth, 0)], -1)
        cuts = [lo, *(np.flatnonzero(term[1:] != term[:-1]) + lo + 1).tolist(), hi]
        if len(cuts) == 2:  # equal vectors
            return [(a, min(a + LEAF, hi)) for a in range(lo, hi, LEAF)]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if out and b - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def bounds(self, repeats: np.ndarray) -> np.ndarray:
        """For each node and item, what no document under the node can exceed: every term as often as anywhere below, with the least m below."""
        most = np.zeros((len(self.ranges), len(self.weight)), np.int64)
        least = np.zeros(len(self.ranges), np.int64)
        for node in reversed(range(len(self.ranges))):
            lo, hi = self.ranges[node]
            if self.children[node]:
                most[node] = most[self.children[node]].max(0)
            else:
                a, b = self.starts[lo], self.starts[hi - 1] + self.lens[hi - 1]
                np.maximum.at(most[node], self.ranks[a:b], self.tf[a:b])
            least[node] = self.m[lo:hi].min()
        gain = self.weight * (1_000_000_000 * most // (1000 * most + 12 * least[:, None]))
        return gain.astype(np.float64) @ repeats.T * (1 + 1e-9)

    def search(self, best: Best) -> None:
        """Goes down the tree depth first with the items that may still find a better document below, and scores the documents of the leaves that are left."""
        bounds, todo = self.bounds(best.repeats), [(0, np.arange(len(best.least)))]
        while todo:
            node, items = todo.pop()
            items = items[bounds[node, items] >= best.least[items]]
            if not len(items):
                continue
            if self.children[node]:
                todo += [(c, items) for c in reversed(self.children[node])]
                continue
            lo, hi = self.ranges[node]
            a, b = self.starts[lo], self.starts[hi - 1] + self.lens[hi - 1]
            ranks, gain, at = self.ranks[a:b], self.gain[a:b], self.starts[lo:hi] - a
            for i in items:
                scores = np.add.reduceat(gain * best.repeats[i, ranks], at)
                for k in np.flatnonzero(scores >= best.least[i]):
                    best.add(i, int(scores[k]), lo + int(k))


class Best:
    """The `top` best documents of each item so far; least[i] is what a document has to reach."""

    def __init__(self, repeats: np.ndarray, top: int):
        self.repeats, self.top, self.ids = repeats, top, []
        self.least = np.ones(len(repeats), np.int64)
        self.found: list[list[tuple]] = [[] for _ in range(len(repeats))]

    def add(self, item: int, score: int, doc: int) -> None:
        found, doc_id = self.found[item], self.ids[doc]
        insort(found, (-score, doc_id is None, 0 if doc_id is None else doc_id))
        if len(found) > self.top:
            found.pop()
        if len(found) == self.top:
            self.least[item] = -found[-1][0]


def _vectors(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """_id, n, terms, tfs of every document with at least one term; terms are places in the sorted list of the items' terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        for b in by_bytes(batches, "_text"):
            rows, sizes, found, tfs = [], [], [], []
            for k, text in enumerate(b.column("_text").cast(pa.binary()).to_pylist()):
                seen = count_terms(text)
                if seen:
                    mine = seen.keys() & place.keys()
                    rows.append(k)
                    sizes.append((seen.total(), len(mine)))
                    found += [place[t] for t in mine]
                    tfs += [seen[t] for t in mine]
            ends = pa.array(np.r_[0, np.cumsum([s for _, s in sizes], dtype=np.int64)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(rows, pa.int64())), pa.array([n for n, _ in sizes], pa.int64()), *lists], ["_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    return written(rows.mapInArrow(tidy(run), f"_id {dict(rows.dtypes)['_id']}, n bigint, terms array<int>, tfs array<bigint>"), "vectors")


def _ranked(vectors: DataFrame, rank: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """_id, m, vec, tfs: terms as big-endian ranks in ascending order, so that bytes sort like term vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tfs = b.column("terms"), b.column("tfs")
            lens = np.diff(terms.offsets.to_numpy())
            ranks = rank[terms.flatten().to_numpy()]
            order = np.lexsort((ranks, np.repeat(np.arange(len(lens)), lens)))
            ends = pa.py_buffer(np.r_[0, np.cumsum(lens) * 4].astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(lens), [None, ends, pa.py_buffer(x.tobytes())]) for x in (ranks[order].astype(">u4"), tfs.flatten().to_numpy()[order].astype("<u4"))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("m"), *packed], ["_id", "m", "vec", "tfs"])

    share = (F.lit(25).cast("decimal(2,0)") * F.col("n").cast("decimal(17,0)")) * F.lit(n_docs).cast("decimal(17,0)")
    rows = vectors.where(F.size("terms") > 0).withColumns({"_share": share, "_all": F.lit(n_terms).cast("decimal(20,0)")}).select("_id", "terms", "tfs", F.expr("75 + (_share div _all)").alias("m"))
    return rows.mapInArrow(tidy(run), f"_id {dict(vectors.dtypes)['_id']}, m bigint, vec binary, tfs binary")


def _found(ranked: DataFrame, weight: np.ndarray, queries: list[tuple[int, list[tuple[int, int]]]], top: int) -> DataFrame:
    """_item, _id, score: the best documents of each item in each part of the documents."""
    sent = ranked.sparkSession.sparkContext.broadcast((weight, queries))
    lot = max(LEAF, min(LOT, LEAF * (CELLS // (3 * max(1, len(weight))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = sent.value
        repeats = np.zeros((len(queries), len(weight)), np.int64)
        for i, (_, terms) in enumerate(queries):
            for r, n in terms:
                repeats[i, r] = n
        best, held, m = Best(repeats, top), ([], [], []), []

        def through() -> None:
            best.ids = held[0]
            DocumentTree(held[1], held[2], np.array(m, np.int64), weight).search(best)
            for x in (*held, m):
                x.clear()

        size = 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("_id", "vec", "tfs", "m")]
            for row in zip(*columns, strict=True):
                for x, v in zip((*held, m), row, strict=True):
                    x.append(v)
                size += len(row[1])
                if len(m) >= lot or size >= CELLS:
                    through()
                    size = 0
        if m:
            through()
        rows = [(queries[i][0], None if null else doc, -score) for i, found in enumerate(best.found) for score, null, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["_item", "_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(ranked.schema["_id"].dataType)
    spread = ranked.repartitionByRange(F.substring("vec", 1, 32), "_id").sortWithinPartitions("vec")
    return spread.mapInArrow(tidy(run), f"_item bigint, _id {dict(ranked.dtypes)['_id']}, score bigint")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_items: int = 256, block_bytes: int = 2_000_000) -> DataFrame:
    """item_col, rank, id_col, score: the `top` best documents for the whole text of each item.

    Terms are maximal runs of letters and digits of ASCII and of all other characters
    beyond it, A-Z lower-cased. A document with n of all L terms has
    m = 75 + (25 n N div L), a term of w = floor(1000 ln((2 N + 2) / (2 df + 1))) that it
    holds tf times adds w ((10^9 tf) div (1000 tf + 12 m)) for each time the item has
    it. Equal scores rank by ascending id; scores of 0 aren't returned.

    One pass counts the items' terms in every document. The vectors, by falling
    document frequency, are dealt to ranges and sorted, so that each task builds
    tries of documents that share their first terms (a lot of documents each) and
    goes down them depth first, by what frequencies and m under a node allow at
    most, for each item, against the best documents that the task has found; ranges
    hold the id too, so documents with equal vectors spread. Items go in blocks of
    bounded size, each a pass over the documents; only items, their terms'
    frequencies and two totals reach the driver.

    Null and empty texts, on both sides, match nothing and don't count as documents.
    Null ids rank after others; items that repeat an id are items of their own, each
    with its ranks; rows that repeat a document are documents. Other columns aren't
    read; empty tables give no rows.
    """
    items = written(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_col).alias("_item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    found = None
    for block in range(blocks):
        mine = [(r._item, count_terms(r.text.encode())) for r in items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).collect()]  # of bounded size
        terms = sorted(set().union(*(c for _, c in mine)))
        vectors = _vectors(docs, terms, id_col, text_col)
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        order = np.lexsort((np.arange(len(terms)), -df))
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df[order]], np.int64)
        place = {t: int(rank[i]) for i, t in enumerate(terms)}
        queries = [(key, [(place[t], k) for t, k in c.items()]) for key, c in mine]
        part = _found(_ranked(vectors, rank, n_docs, n_terms), weight, queries, top)
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = written(found, "found").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return ranked.join(items.select("_item", "_item_id"), "_item").select(F.col("_item_id").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
