"""Similarity join of documents on their sets of word shingles, by parity sketches (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import bloom_filter, bloom_holds, bloom_size, by_bytes, text_hash, tidy, without, written
from siglot.llm.components import components

SLOTS = 1 << 21  # counters of shingle hashes, one set for the whole corpus
BLOCKS = 64  # pieces in which a task's counters are added to the others'
FINE = 8  # words of a sketch per shingle of the largest set of its band
SMALL = 64  # below this size every shingle is a part of its own
PAIRWISE = 16  # sets of a group that are compared pair by pair
LEFT = 64  # pairs for each class that may be left to one last comparison


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of each text of a batch."""

    def __init__(self, words: int):
        self.k = words

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        cut = [t.encode("utf-8").lower().split() if t else [] for t in texts]  # bytes: only A-Z, and only ASCII white space
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(cut)), np.uint64, int(n.sum()))
        x, out = self._runs(h, self.k), []  # of all texts at once; runs across two texts are left out
        for start, size in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            u = np.sort(x[start : start + size - self.k + 1] if size >= self.k else self._runs(h[start : start + size], size))
            out.append(u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u)
        return out

    @staticmethod
    def _runs(h: np.ndarray, k: int) -> np.ndarray:
        """A hash of every run of k words."""
        x = np.full(max(0, len(h) - k + 1) if k else 0, k, np.uint64)
        for j in range(k):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(x)])
        return x


def set_hash(u: np.ndarray, clashes: dict[tuple[int, int], int] | None = None) -> tuple[int, int]:
    """The two halves of a set's 128-bit hash. The first names the set, but for the few sets in clashes, which share it with another one and get a name of their own."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(u.tobytes())
    low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    return (clashes.get((low, high), low) if clashes else low), high


def most_apart(n: int, low: int, high: int, num: int, den: int) -> int:
    """The largest symmetric difference of a set of n and one of m in low..high that reach similarity num/den; -1 where none do."""
    low, high, most = max(low, -(-n * num // den)), min(high, n * den // num), -1
    for m in range(high, max(low, high - 2 * (num + den)) - 1, -1):
        both = -(-(n + m) * num // (num + den))
        if both <= min(n, m):
            most = max(most, n + m - 2 * both)
    return most


def band_of(n: int) -> int:
    """0 below SMALL, else by powers of four."""
    return 0 if n < SMALL else (n.bit_length() - 1) // 2


def band_range(band: int) -> tuple[int, int]:
    return (1, SMALL - 1) if band == 0 else (4**band, 4 ** (band + 1) - 1)


def sketch_keys(u: np.ndarray, heat: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys by which the set u meets every different set of similarity num/den or more.

    In each size band the sketch has FINE times as many 64-bit words as the largest set
    has shingles; every shingle is XORed into one word. Two sets' sketches differ in
    no more words than their symmetric difference has shingles. If at most d of a
    set's non-empty words may differ, any d + 1 of them hold one that a partner
    shares; taken in one global order (by how frequent the word's rarest shingle is,
    then by hash), the first d + 1 of both sets must meet. A set near the lower edge
    of its band also joins the band below with that band's sketch.
    """
    n, out = len(u), []
    own = band_of(n)
    for band in {own, band_of(max(1, -(-n * num // den)))}:
        low, high = band_range(band)
        d = most_apart(n, low if band == own else low, n * den // num if band == own else high, num, den)
        if d < 1:  # only equal sets reach the threshold, and these are one class already
            continue
        parts = np.uint64(FINE * 4 ** (band + 1) - 1 if band else 0xFFFFFFFFFFFFFFFF)
        part = u & parts
        order = np.argsort(part, kind="stable")
        part, w = part[order], mix(u[order] + np.uint64(band + 1))
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word = np.bitwise_xor.reduceat(w, starts)
        key = mix(word ^ mix(part[starts] + np.uint64(band << 56)))
        rare = np.minimum.reduceat(heat[_slot(u[order])], starts)
        if len(key) > d + 1:
            place = rare.astype(np.uint64) << np.uint64(56) | key >> np.uint64(8)
            key = key[np.argpartition(place, d)[: d + 1]]
        out.append(key)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bit_sketch(u: np.ndarray) -> np.ndarray:
    """One parity bit for each of m places, m a power of two and at least twice the set's size, as 64-bit words. Half as long, it is the XOR of its halves."""
    m = max(64, 1 << (2 * len(u) - 1).bit_length())
    bits = np.bincount((u >> np.uint64(8) & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _slot(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(43)).astype(np.int64)


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: _id, _tid (hash of the text), n, node and other (the halves of the set's hash), sketch. kind 1: a task's counters of shingles (_id: task, n: block, counts: one byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen = Shingler(words), np.zeros(SLOTS, np.int32)
        names = ["kind", "_id", "_tid", "n", "node", "other", "sketch", "counts"]
        for b in by_bytes(batches, "_text", 1_000_000):
            sets = sh.batch(b.column("_text").to_pylist())
            if sum(map(len, sets)):
                seen += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS).astype(np.int32)
            node, other = _signed([set_hash(u) if len(u) else (0, 0) for u in sets]).reshape(-1, 2).T
            n = np.array([len(u) for u in sets], np.int64)
            sketch = pa.array([bit_sketch(u) if len(u) else None for u in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column("_id"), b.column("_tid"), pa.array(n), pa.array(node), pa.array(other), sketch, pa.nulls(len(n), pa.binary())], names)
        if seen.any():
            parts = [x.tobytes() for x in np.split(np.minimum(seen, 255).astype(np.uint8), BLOCKS)]
            task, z = TaskContext.get().partitionId(), pa.nulls(BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * BLOCKS, pa.int32()), pa.array([task] * BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int64()), z, z, pa.nulls(BLOCKS, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(tidy(run), "kind int, _id bigint, _tid binary, n bigint, node bigint, other bigint, sketch array<bigint>, counts binary")


def _clashes(sets: DataFrame) -> dict[tuple[int, int], int]:
    """Names for the sets in sets(node, other) that share the first half of their hash with another set: about the square of the number of sets by 2^65, none or a handful at any size."""
    twice = sets.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.collect_set("other").alias("others")).where("k > 1").collect()
    word = lambda x: x & 0xFFFFFFFFFFFFFFFF
    return {(word(r.node), word(o)): word(r.node + k) for r in twice for k, o in enumerate(sorted(r.others))}


def _heat(profiles: DataFrame) -> np.ndarray:
    """How frequent each slot's shingles are in the whole corpus, in eighths of powers of two: SLOTS bytes, whatever the input. It only orders keys, so that common passages come last. Tasks' counters are added in two rounds, 64 tasks at a time and then all."""

    def add(kind):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(SLOTS // BLOCKS, np.int64)
            for x in pdf["counts"]:
                total += np.frombuffer(x, kind)
            return pd.DataFrame({"_id": [0], "n": pdf["n"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})

        return run

    parts = profiles.where("kind = 1").select((F.col("_id") / 64).cast("bigint").alias("_id"), "n", "counts")
    some = parts.groupBy("_id", "n").applyInPandas(add(np.uint8), "_id bigint, n bigint, counts binary")
    every = some.groupBy("n").applyInPandas(add(np.int64), "_id bigint, n bigint, counts binary").collect()
    heat = np.zeros(SLOTS, np.uint8)
    for r in every:
        at = r.n * (SLOTS // BLOCKS)
        heat[at : at + SLOTS // BLOCKS] = np.minimum(255, np.round(8 * np.log2(1 + np.frombuffer(r.counts, np.int64))))
    return heat


def _turn(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The place of a node among those of a key: one of sixteen orders, so that the keys that a large group shares have different leads, and a node unlike one lead meets others."""
    return mix(node ^ mix((key & np.uint64(15)) + np.uint64(1)))


def _keys(docs: DataFrame, heat, clashes: dict, words: int, num: int, den: int) -> DataFrame:
    """key, node, lead: per part of a task each key's first node (lead null, or itself where others follow) and, with that node as lead, the key's other nodes in the part."""

    def gathered(ks: list[np.ndarray], ns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, n = np.concatenate(ks), np.concatenate(ns)
        order = np.lexsort((_turn(k, n), k))
        k, n = k[order], n[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        lead = n[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else n
        only = first & np.concatenate([first[1:], [True]])[: len(k)]
        back = np.argsort(order)  # in the order of the documents again: rows of one node compress well
        k, n, only, lead = k[back], n[back], only[back], lead[back]
        for i in range(0, len(k), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[s].view(np.int64)), pa.array(n[s].view(np.int64)), pa.array(lead[s].view(np.int64), mask=only[s])], ["key", "node", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, done, ks, ns, size = Shingler(words), set(), [], [], 0
        for b in by_bytes(batches, "_text", 1_000_000):
            for u in sh.batch(b.column("_text").to_pylist()):
                if len(u) and (node := set_hash(u, clashes)[0]) not in done:
                    done.add(node)
                    k = np.unique(sketch_keys(u, heat.value, num, den) >> np.uint64(16))  # shorter keys: a clash of two adds pairs and loses none
                    ks.append(k)
                    ns.append(np.full(len(k), node, np.uint64))
                    size += len(k)
            if size > 250_000:  # a bounded part of the task's keys at a time
                yield from gathered(ks, ns)
                ks, ns, size = [], [], 0
            if len(done) > 100_000:  # a node that comes again then gives the same keys again
                done.clear()
        if ks:
            yield from gathered(ks, ns)

    return docs.mapInArrow(tidy(run), "key bigint, node bigint, lead bigint")


def _repeated(keys: DataFrame) -> DataFrame:
    """The rows of keys with two nodes or more, each with a lead.

    Spark sorts each partition by key, and a key's rows are taken off the stream one
    run after the other, so a task holds one batch and what is left of one key: tasks
    have gathered a key's nodes before, so that it brings at most one row of each
    part of a task. Near copies share many keys. Where all nodes of a key are here,
    their hash takes its place, so that keys of the same nodes are one group; two
    nodes are no more than a pair, and have no key. (Groups whose hashes clash become
    one, which adds pairs and loses none.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n, more = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)  # rows whose key may go on

        def done(k: np.ndarray, n: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((n, k))
            k, n, more = k[order], n[order], more[order]
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])[: len(k)])  # equal sets of several tasks are one node
            if not len(at):
                return
            k, n, more = k[at], n[at], np.logical_or.reduceat(more, at)
            at, size, group = _groups(k)
            whole = ~np.logical_or.reduceat(more, at)
            k = np.where(whole[group], mix(np.add.reduceat(mix(n), at) + size.astype(np.uint64))[group], k)
            k, n, whole = (x[size[group] > 1] for x in (k, n, whole[group]))
            if not len(k):
                return
            turn = _turn(k, n)
            order = np.lexsort((turn, k))
            k, n, whole, turn = k[order], n[order], whole[order], turn[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (turn[1:] != turn[:-1])])
            k, n, whole = k[new], n[new], whole[new]
            at, size, group = _groups(k)
            lead, pair = n[at][group], whole & (size[group] == 2)
            k, n, lead, pair = (x[~pair | (n != lead)] for x in (k, n, lead, pair))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64), mask=pair), pa.array(n.view(np.int64)), pa.array(lead.view(np.int64))], ["key", "node", "lead"])

        for b in batches:
            first = pc.or_kleene(pc.is_null(b.column("lead")), pc.equal(b.column("lead"), b.column("node")))
            member = b.filter(pc.invert(first))
            if member.num_rows:
                yield member
            alone = b.filter(first)
            if not alone.num_rows:
                continue
            word = lambda c: alone.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
            k, n = np.concatenate([k, word("key")]), np.concatenate([n, word("node")])
            more = np.concatenate([more, pc.is_valid(alone.column("lead")).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1]))
            yield from done(k[:last], n[:last], more[:last])
            k, n, more = k[last:], n[last:], more[last:]
        yield from done(k, n, more)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, F.when(F.col("lead").isNull() | (F.col("lead") == F.col("node")), F.col("key")).otherwise(F.col("node")))
    return dealt.sortWithinPartitions("key").mapInArrow(tidy(run), "key bigint, node bigint, lead bigint")


def _groups(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of equal keys their first places and sizes, and each row's run."""
    first = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(k))), np.cumsum(first) - 1


class _Join:
    """What the rounds of one join share: the documents (_tid, _text), their classes (node, tid, n, sketch), the shingles' heat and the threshold."""

    def __init__(self, docs: DataFrame, classes: DataFrame, heat, clashes: dict, words: int, num: int, den: int):
        self.docs, self.classes, self.heat, self.clashes, self.words, self.num, self.den = docs, classes, heat, clashes, words, num, den

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, n, u (sorted shingle hashes), common (how frequent its shingles are on average) of the classes in nodes(node), from the text of one representative each."""
        need = written(nodes.distinct().join(self.classes, "node").select("node", F.col("tid").alias("_tid")), "need")
        n_words = bloom_size(need.count())
        bits = bloom_filter(need.select(F.xxhash64("_tid").alias("h")), "h", n_words)
        texts = self.docs.where(bloom_holds(bits, F.xxhash64("_tid"), n_words)).groupBy("_tid").agg(F.min("_text").alias("_text"))  # copies are dropped before the shuffle
        rows = texts.join(need, "_tid").select("node", "_text")
        words, heat, clashes = self.words, self.heat, self.clashes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sh = Shingler(words)
            for b in by_bytes(batches, "_text", 1_000_000):
                sets = sh.batch(b.column("_text").to_pylist())
                n = [len(u) for u in sets]
                common = [float(heat.value[_slot(u)].mean()) if len(u) else 0.0 for u in sets]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int64()), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64())), pa.array(common, pa.float64())], ["node", "n", "u", "common"])

        return written(rows.mapInArrow(tidy(run), "node bigint, n bigint, u array<bigint>, common double"), "sets", 2_000)

    def least_both(self, n: str, m: str) -> str:
        """SQL for the least intersection at which sets of n and m are linked."""
        return f"cast(ceil(({n} + {m}) * {self.num} / {self.num + self.den}) as bigint)"

    def sizes_fit(self, n: str, m: str) -> str:
        return f"least({n}, {m}) * {self.den} >= greatest({n}, {m}) * {self.num}"

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that may reach the similarity by their sizes and by the Hamming distance of their bit sketches, which never exceeds the symmetric difference."""
        n = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
        pairs = written(pairs.join(n("a"), "a").join(n("b"), "b").where(self.sizes_fit("na", "nb")), "fits")
        need = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "need")
        n_words = bloom_size(need.count())
        some = self.classes.where(bloom_holds(bloom_filter(need.select(F.xxhash64("node").alias("h")), "h", n_words), F.xxhash64("node"), n_words))  # sketches of other classes stay where they are
        side = lambda x: some.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        half = lambda s: F.zip_with(F.slice(s, 1, F.expr(f"size({s}) div 2")), F.slice(s, F.expr(f"size({s}) div 2 + 1"), F.expr(f"size({s}) div 2")), lambda x, y: x.bitwiseXOR(y))
        fit = lambda s, t: F.when(F.size(s) > F.size(t), half(s)).otherwise(F.col(s))
        both = both.withColumns({"sa": fit("sa", "sb"), "sb": fit("sb", "sa")})
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return written(both.where(apart <= F.expr(f"na + nb - 2 * {self.least_both('na', 'nb')}")).select("a", "b"), "near")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the similarity."""
        pairs = self.near(pairs)
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        side = lambda x: sets.select(F.col("node").alias(x), F.col("u").alias(f"u{x}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return written(joined.where(F.size(F.array_intersect("ua", "ub")) >= F.expr(self.least_both("size(ua)", "size(ub)"))).select("a", "b"), "links")

    def overlaps(self, groups: DataFrame) -> DataFrame:
        """lead, node, n, m (size of the lead), r (the node's shingles that the lead has not), both, linked: the nodes of groups(key, node) against their group's lead."""
        sets = self.sets(groups.select("node"))
        jobs = groups.join(self.leads(groups, sets), "key").select("lead", "node").distinct()
        p = sets.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("u").alias("up"))
        rows = jobs.join(sets, "node").join(p, "lead").select("lead", "node", "n", "m", F.array_except("u", "up").alias("r")).withColumn("both", F.col("n") - F.size("r"))
        return written(rows.withColumn("linked", F.expr(f"both >= {self.least_both('n', 'm')}")), "overlaps")

    def leads(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """key, lead: of the smallest quarter of a group's sets the one whose shingles are the most frequent, as the likely middle of its near copies."""
        sized = written(groups.join(sets.select("node", "n", "common"), "node"), "sized")
        quarter = sized.groupBy("key").agg(F.percentile_approx("n", 0.25).alias("q"))
        some = sized.join(written(quarter, "quarters"), "key").where("n <= q")
        return written(some.groupBy("key").agg(F.max_by("node", F.struct("common", "node")).alias("lead")), "leads")

    def narrowed(self, over: DataFrame, found: DataFrame) -> DataFrame:
        """Groups (key, node) in which all linked pairs meet that share a lead and aren't in one component yet.

        Let p be a lead, x and y two linked sets with at least b common shingles, and
        px, py what p has in common with them. x and y share at least
        b - min(px, py) shingles that p has not. If that is none and neither x nor y is
        smaller than p, then both are linked to p and in its component. So it is enough
        to let sets meet under the shingles that p has not: of r such ones, of which t
        at least are shared, the first r - t + 1 in one order. What is left are pairs
        of a set that narrowly misses p, and one smaller than p that lies nearly
        whole in it: these form one more group.
        """
        d, e = self.num, self.num + self.den
        over = over.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        inside = f"n < m and both * {e} >= 2 * n * {d}"
        per = over.groupBy("lead").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.min(F.when(F.expr(inside), F.col("n"))).alias("least_in")
        ).where("lo <> hi")
        rows = written(over.join(written(per, "perlead"), "lead"), "open").where("node <> lead")
        smallest = lambda c: f"greatest({c}, cast(ceil(n * {d} / {self.den}) as bigint))"
        share = F.expr(f"if(linked, 1, greatest(1, {self.least_both('n', smallest('least'))} - both))")
        rest = rows.withColumns({
            "take": F.size("r") - share + 1,
            "misses": F.expr(f"not linked and least_in is not null and both >= {self.least_both('n', smallest('least_in'))}"),
            "inside": F.expr(inside),
        })
        missed = written(rest.where("misses").select("lead").distinct(), "missed")
        more = rest.where("misses or inside").join(missed, "lead", "left_semi").select(F.xxhash64(F.lit("inside"), "lead").alias("key"), "node")
        heat = self.heat

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ks, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                leads = mix(b.column("lead").to_numpy().view(np.uint64))
                for lead, node, take, r in zip(leads, b.column("node").to_pylist(), b.column("take").to_pylist(), b.column("r"), strict=True):
                    u = r.values.to_numpy().view(np.uint64)
                    ks.append(mix(u[np.lexsort((u, heat.value[_slot(u)]))[:take]] ^ lead))
                    ns.append(np.full(len(ks[-1]), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(ns))], ["key", "node"])

        return rest.where("take > 0").select("lead", "node", "take", "r").mapInArrow(tidy(run), "key bigint, node bigint").unionByName(more)

    def apart(self, repeated: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """key, node of the keys whose nodes lie in different components after the first comparison. A key's nodes hang together by its rows (node, lead), so it has a pair of these that isn't in one component; all other keys' rows, the most by far, are neither moved nor written again."""
        root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        two = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)")
        repeated = repeated.where("key is not null")  # a pair without a key has been compared
        rows = repeated.where("node <> lead").select("key", *_ordered("node", "lead"))
        keys = written(_held(rows, ["a", "b"], written(two.select("a", "b"), "apart")).select("key").distinct(), "mixed")
        some = written(_held(repeated, ["key"], keys), "held")
        return some.select("key", F.explode(F.array("node", "lead")).alias("node")).distinct()

    def mixed(self, spots: DataFrame, found: DataFrame, least: int) -> DataFrame:
        """key, node, root, k (nodes of the key, at least `least`) of the groups with nodes of different components."""
        spots = written(spots.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "spots")
        mixed = spots.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")).where(f"lo <> hi and k >= {least}").select("key", "k")
        return written(spots.join(written(mixed, "mixed"), "key"), "rest")

    def across(self, rest: DataFrame) -> DataFrame:
        """The pairs of nodes of one key and different components."""
        sized = written(rest.join(self.classes.select("node", "n"), "node"), "sides")
        alike = f"x.key = y.key and x.root < y.root and {self.sizes_fit('x.n', 'y.n')}"
        return sized.alias("x").join(sized.alias("y"), F.expr(alike)).select(*_ordered("x.node", "y.node")).distinct()


def _held(rows: DataFrame, names: list[str], table: DataFrame) -> DataFrame:
    """The rows whose names are in a stored table. A Bloom filter of these lets only rows that it holds go to the join."""
    n_words = bloom_size(table.count())
    bits = bloom_filter(table.select(F.xxhash64(*names).alias("h")), "h", n_words)
    return rows.where(bloom_holds(bits, F.xxhash64(*names), n_words)).join(table, names, "left_semi")


def _ordered(a: str, b: str) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def ngram_join(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links) of the join of docs with itself at Jaccard similarity num/den.

    documents: id_col, tid (hash of the text), n_shingles, node, component_id, a row for each row of docs;
    node names its class, the documents of equal sets. classes: node, root,
    min_id. links: a, b, verified pairs of different classes. Every link between
    different sets is found or lies inside a component that other links join.

    First a key's first node is compared with all others of the key. Then groups of
    up to PAIRWISE nodes are compared pair by pair where components differ, and each
    larger group with a lead in its middle; linked pairs that the lead doesn't join
    must share shingles that the lead has not, and meet under these in smaller
    groups (`narrowed`). This goes on until groups are small, or all that is left
    makes fewer than LEFT pairs for each class. So the pairs compared grow with the
    input, not with the square of a group's size.

    Words are maximal runs without ASCII white space, with A-Z in lower case; fewer
    words than a shingle make one shingle; a text without words, or null, has none
    and is linked with nothing (its component is its own id). Null ids take part,
    but name no component. Repeated rows each give a row; other columns aren't read;
    an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_hash(F.col(text_col)).alias("_tid"), F.col(text_col).alias("_text"))
    profiles = written(_profiles(docs, words), "profiles", 2_000)
    heat = spark.sparkContext.broadcast(_heat(profiles))
    people = profiles.where("kind = 0").drop("kind")
    each = written(people.where("n > 0").groupBy("node", "other").agg(F.min("_tid").alias("tid"), F.min("_id").alias("min_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    clashes, classes = _clashes(each), each
    if clashes:
        names = spark.createDataFrame([(*_signed([a, b]).tolist(), int(_signed([c])[0])) for (a, b), c in clashes.items()], "node bigint, other bigint, name bigint")
        renamed = lambda df: df.join(F.broadcast(names), ["node", "other"], "left").withColumn("node", F.coalesce("name", "node")).drop("name")
        people, classes = renamed(people), written(renamed(each), "classes")

    repeated = written(_repeated(_keys(docs, heat, clashes, words, num, den)), "keys", 4_000)
    join = _Join(docs.select("_tid", "_text"), classes, heat, clashes, words, num, den)

    pairs = written(repeated.where("node <> lead").select(*_ordered("node", "lead")).distinct(), "pairs")
    links = join.links(pairs)
    found = written(components(links, "a", "b"), "components")
    n_classes = classes.count()
    spots, least = join.apart(repeated, pairs, found), 3  # the pair of a key with two nodes has been compared
    while True:
        rest = join.mixed(spots, found, least)
        large = rest.where(f"k > {PAIRWISE}")
        in_large = large.groupBy("key").agg(F.first("k").alias("k")).agg(F.sum("k").alias("n"), F.sum(F.expr("k * (k - 1) / 2")).alias("pairs")).first()
        go_on = in_large.n and in_large.pairs > LEFT * n_classes
        new = join.across(rest.where(f"k <= {PAIRWISE}") if go_on else rest)
        new = written(new.join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = join.links(new)
        if go_on:
            over = join.overlaps(large.select("key", "node"))
            more = written(more.union(over.where("linked and node <> lead").select(*_ordered("node", "lead")).distinct()), "links")
        if more.limit(1).count():
            links = written(links.union(more).distinct(), "links")
            stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = written(components(stars.union(more), "a", "b"), "components")
        if not go_on:
            break
        pairs = pairs.union(new)
        spots = written(join.narrowed(over, found), "spots")
        twice = spots.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
        spots, least = _held(spots, ["key"], written(twice, "twice")).distinct(), 2  # most keys have one node

    rooted = classes.join(found, "node", "left").select("node", "min_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("node", "root", "min_id", "component_id"), "named")
    some = people.where("n > 0").join(named.select("node", "component_id"), "node").select("_id", "_tid", "n", "node", "component_id")
    none = people.where("n = 0").select("_id", "_tid", "n", F.lit(None).cast("bigint").alias("node"), F.col("_id").alias("component_id"))
    out = some.union(none).select(F.col("_id").alias(id_col), F.col("_tid").alias("tid"), F.col("n").alias("n_shingles"), "node", "component_id")
    return out, named.select("node", "root", "min_id"), links


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are their component's least id. Rows without words stay, as do rows of components in which all ids are null; rows that repeat the least id and its set of shingles stay together."""
    found = ngram_join(docs, id_col=id_col, text_col=text_col, **how)[0]
    named = lambda i, t: F.struct(i.cast("bigint").alias("i"), t.alias("t"))
    gone = found.where(F.col("component_id") != F.col(id_col)).select(named(F.col(id_col), F.col("tid")).alias("h")).distinct()
    return without(docs, written(gone, "gone"), named(F.col(id_col), text_hash(F.col(text_col))))
