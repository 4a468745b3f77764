"""Phrase collocation mining by multikey three-way quicksort of suffix pointers (operator 11)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, tidy, written

# What ends a piece, and what else parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b"\t "
END = b"."  # stands between pieces, as no word has it
SLICE = 8_000_000  # bytes of text whose suffixes are added up before they leave a task
RANGE = 2_000_000  # bytes of text whose suffixes one range gets, as a goal
ROWS = 50_000  # of a batch of results


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, END between pieces."""
    table = bytes(END[0] if c in PIECE_ENDS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
    return END.join(texts).translate(table).replace(END, b" . ").split()


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about `most` bytes that end where a piece ends, which no phrase crosses."""
    end, start = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]"), 0
    while len(text) - start > most and (m := end.search(text, start + most)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def _coded(texts: list[bytes]) -> pa.DictionaryArray:
    """The words of texts as codes, an END before each text."""
    return pa.array([END, *words_of(texts)], pa.binary()).dictionary_encode()


def _suffixes(parts: list[pa.DictionaryArray], longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary in byte order, the distinct suffixes cut to `longest` words in the order of their words (places in the vocabulary, 0 for END past the end of their piece), and how often each occurs."""
    coded = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    order = np.r_[names.index(END).as_py(), order[order != names.index(END).as_py()]]  # END first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, names, size = place[coded.indices.to_numpy()], names.take(pa.array(order)), len(order)
    columns, live = [code], code != 0
    for k in range(1, longest):
        following = np.zeros(len(code), np.int64)
        following[:-k] = code[k:]
        columns.append(np.where(columns[-1] != 0, following, 0))
    columns = [c[live] for c in columns]
    if size**longest < 1 << 63:  # one number for all words, taken apart again afterwards
        group = columns[0]
        for c in columns[1:]:
            group = group * size + c
        group, n = np.unique(group, return_counts=True)
        columns = []
        for _ in range(longest):
            group, c = np.divmod(group, size)
            columns.insert(0, c)
    else:
        group = columns[0]
        for c in columns[1:]:
            group = np.unique(group * size + c, return_inverse=True)[1]
        _, first, n = np.unique(group, return_index=True, return_counts=True)
        columns = [c[first] for c in columns]
    return names, np.column_stack(columns), n.astype(np.int64)


def _cuts(names: list[bytes], rows: np.ndarray, bounds: list[tuple[bytes, ...]]) -> list[int]:
    """Where each bound would stand among the sorted rows."""
    out = []
    for bound in bounds:
        lo, hi = 0, len(rows)
        for k, word in enumerate(bound):
            at = 0 if word == END else bisect_left(names, word, 1)
            column = rows[lo:hi, k]
            hi, lo = lo + int(np.searchsorted(column, at, "right" if at < len(names) and names[at] == word else "left")), lo + int(np.searchsorted(column, at))
            if lo == hi:
                break
        out.append(lo)
    return out


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: int, shared: np.ndarray | None = None, seed: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a row of each equal partition, its weight) depth by depth, by multikey three-way quicksort of row pointers.

    columns[d] is the code of a suffix's word at depth d, below 0 past its end. All
    segments of pointers at a depth are split at once: each takes one of its own words
    as pivot and falls into less, equal and greater. The equal partition is done at
    this depth, its weight is a count, and it goes on at the next depth; the other
    two are split again. A segment lighter than `least` is abandoned, as nothing in
    it can be frequent, unless it holds a row whose first words, more than this
    depth's, are `shared` with suffixes of other tasks.
    """
    shared = np.zeros(len(weight), np.int64) if shared is None else shared
    random = np.random.default_rng(seed)
    order, segment = np.arange(len(weight)), np.zeros(len(weight), np.int64)

    def goes_on(order: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.add.reduceat(weight[order], starts)
        return total, (total >= least) | np.logical_or.reduceat(shared[order] > depth, starts)

    for depth, column in enumerate(columns):
        alive = column[order] >= 0
        order, segment = order[alive], segment[alive]
        done, n_done = [], 0
        while len(order):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[starts, len(order)])
            _, keep = goes_on(order, starts, depth)
            order, sizes = order[np.repeat(keep, sizes)], sizes[keep]
            if not len(order):
                break
            starts, place, key = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), column[order]
            side = np.sign(key - np.repeat(key[starts + (random.random(len(sizes)) * sizes).astype(np.int64)], sizes))
            equal = side == 0
            done.append((order[equal], place[equal] + n_done))
            n_done += len(sizes)
            order, segment = order[~equal], (place * 2 + (side > 0))[~equal]
            split = np.argsort(segment, kind="stable")
            order, segment = order[split], segment[split]
        if not done:
            return
        order, segment = (np.concatenate(x) for x in zip(*done, strict=True))
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        total, keep = goes_on(order, starts, depth)
        yield depth + 1, order[starts][keep], total[keep]
        stay = np.repeat(keep, np.diff(np.r_[starts, len(order)]))
        order, segment = order[stay], segment[stay]


def _shared(rows: np.ndarray, names: pa.Array) -> np.ndarray:
    """How many leading words each row has in common with the first or the last row of its range, which may go on in the ranges beside it. Codes below 0 are ends and come first."""
    out = np.zeros(len(rows), np.int64)
    for last in (False, True):
        among = np.arange(len(out))
        for depth in range(rows.shape[1]):
            used = np.unique(rows[among, depth])
            if used[-1] < 0 or (not last and used[0] < 0):
                break
            edge = pc.min_max(names.take(pa.array(used[used >= 0])))["max" if last else "min"]
            among = among[rows[among, depth] == names.index(edge).as_py()]
            out[among] = np.maximum(out[among], depth + 1)
    return out


def _bounds(texts: DataFrame, longest: int, sampled: int = 5_000, most_ranges: int = 50_000) -> dict[str, list[tuple[bytes, ...]]]:
    """For each language, the suffixes at which its ranges part, from up to 32 places of some `sampled` texts; they decide who counts what, and no result."""
    n = texts.count()
    share = min(1.0, sampled / max(1, n))
    size = F.length("text")
    k = 1 + F.least(F.lit(31), F.floor(size / 2048).cast("int"))
    at = F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring("text", F.floor(size * (2 * i + 1) / (2 * k)).cast("int"), F.lit(80))))
    some = texts.sample(share, seed=11).select("lang", (F.octet_length("text") / k).alias("bytes"), at.alias("at")).toPandas()
    starts, weights = {}, {}
    for lang, size, text in zip(some["lang"], some["bytes"], some["at"], strict=True):
        words = words_of([text.encode()])[1:]  # the first may be cut
        words = words[next((i for i, w in enumerate(words) if w != END), len(words)) :]
        end = words.index(END) if END in words else len(words)
        if words:
            starts.setdefault(lang, []).append(tuple((words[:end] + [END] * longest)[:longest]))
            weights.setdefault(lang, []).append(size / share)
    total, out = sum(map(sum, weights.values())), {}
    for lang, found in starts.items():
        order = sorted(range(len(found)), key=lambda i: [b"" if w == END else w for w in found[i]])
        so_far = np.cumsum([weights[lang][i] for i in order])
        step = max(RANGE, total / most_ranges)
        out[lang] = sorted({found[order[i]] for i in np.searchsorted(so_far, np.arange(step, so_far[-1], step))}, key=lambda b: [b"" if w == END else w for w in b])
    return out


def _routed(texts: DataFrame, bounds: dict[str, list[tuple[bytes, ...]]], longest: int) -> DataFrame:
    """lang, range, suffixes, n: the suffixes of a slice of texts that go to one range, as their words (END past the end of a piece), and their counts as 64-bit integers."""
    sent = texts.sparkSession.sparkContext.broadcast(bounds)

    def added_up(held: dict[str, list[pa.DictionaryArray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            names, rows, n = _suffixes(parts, longest)
            names, ends = names.to_pylist(), [0]
            ends += [*_cuts(names, rows, sent.value.get(lang, [])), len(rows)]
            words = np.array(names, object)
            for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), pa.array([b" ".join(words[rows[a:b].ravel()])], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], ["lang", "range", "suffixes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in by_bytes(batches, "text"):
            found = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found.setdefault(lang, []).append(text)
            for lang, some in found.items():
                for part in _cut(END.join(some), SLICE):
                    held.setdefault(lang, []).append(_coded([part]))
                    size += len(part)
                    if size >= SLICE:
                        yield from added_up(held)
                        held, size = {}, 0
        yield from added_up(held)

    return texts.mapInArrow(tidy(run), "lang string, range int, suffixes binary, n binary")


def _counted(routed: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, size, f: every phrase of up to `longest` words that occurs at least `least` times; and with size 0 and an empty phrase each language's words.

    A range is sorted by itself, one at a time in a task. Only what begins like its
    first or last suffix can go on in another range, is never abandoned there,
    and is added up.
    """

    def sort(lang: str, blocks: list[bytes], counts: list[bytes]) -> Iterator[pa.RecordBatch]:
        coded = pa.array(b" ".join(blocks).split(), pa.binary()).dictionary_encode()
        names, weight = coded.dictionary, np.frombuffer(b"".join(counts), np.int64)
        rows = coded.indices.to_numpy().reshape(-1, longest).astype(np.int64)
        end = names.index(END).as_py()
        rows[rows == end] = -1
        found = [(0, np.zeros(1, np.int64), np.array([weight.sum()]))]
        for size, at, f in [*found, *equal_partitions(list(rows.T), weight, least, _shared(rows, names))]:
            for k in range(0, len(at), ROWS):
                some = rows[at[k : k + ROWS]]
                words = [names.take(pa.array(some[:, i])).cast(pa.string()) for i in range(size)]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(" ")) if words else pa.array([""])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), phrase, pa.array(np.full(len(some), size, np.int32)), pa.array(f[k : k + ROWS])], ["lang", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, counts = None, [], []
        for b in batches:
            for lang, k, block, n in zip(*(b.column(c).to_pylist() for c in ("lang", "range", "suffixes", "n")), strict=True):
                if key != (lang, k) and blocks:
                    yield from sort(key[0], blocks, counts)
                    blocks, counts = [], []
                key = (lang, k)
                blocks.append(block)
                counts.append(n)
        if blocks:
            yield from sort(key[0], blocks, counts)

    parts = routed.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(tidy(run), "lang string, phrase string, size int, f bigint")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, size, a, l, r, n, score: the phrases of 2 to `longest` words that stick together most, per language.

    Texts are lower-cased (A-Z) and fall at `.,;:!?` and line ends into pieces, and
    these at blanks and tabs into words. A phrase that occurs a >= least times is
    scored by its weakest cut into two parts that occur l and r times:
    floor(1000000 a a / (l r)), of equal cuts the first. It is dropped where some
    longer frequent phrase that holds its words side by side occurs at least
    `within` percent as often. n counts the language's words. The `top` best of each
    language stay, by score, then a, both descending, then phrase in byte order.

    Each task adds up the suffixes of a slice of text, and routes them to ranges by
    their leading words, all of them, so that even a third of all rows with one
    leading word spreads over as many ranges as it needs; a range is counted by
    multikey three-way quicksort (see equal_partitions). Memory is bounded by a
    slice and by a range (2 MB of text, or a 50,000th of the corpus if that is more).
    A null language is `und`, null and empty texts have no words, rows that repeat
    count each, other columns aren't read, and empty tables give no rows. Counts up
    to 10^15 keep the scores exact.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    counted = written(_counted(_routed(texts, _bounds(texts, longest), longest), longest, least), "frequent")
    frequent, sizes = counted.where("size > 0"), counted.where("size = 0").select("lang", F.col("f").alias("n"))

    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    candidates = frequent.where("size >= 2").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    count = lambda side, c: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(c))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"_num": F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")), "_den": big("l") * big("r")})
    scored = cuts.withColumn("score", F.expr("_num div _den")).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    starts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda at: F.struct(at.alias("at"), s.alias("s"))))))
    inner = candidates.where("size >= 3").select("lang", "a", "phrase", starts.alias("p")).select("lang", part(F.col("p.at"), F.col("p.s")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {within} * a")

    first = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "size", "a", "best.l", "best.r", "n", "best.score")
