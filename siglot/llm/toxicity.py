"""Toxicity by a weighted lexicon that is learned from labelled rows (operator 7)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, text_hash, tidy, without, written

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
HOMOGLYPHS = str.maketrans("аеорсухкмтвніјѕԁɡαεορτυχικν", "aeopcyxkmtbhijsdgaeoptuxikv")
DIGITS = str.maketrans("013457", "oieast")
SIGNS = str.maketrans("@$!|", "asil")



def folder():
    """A function from a text to its words: lower case, one form of each letter, look-alike letters and digits or signs inside words turned into Latin letters. Accents stay: in many languages they make another word."""
    other, accent = re.compile("[ɐ-ʯͰ-ԯ]").search, re.compile("[^\x00-\x7f]").search
    mixed, sign = re.compile(r"\b(?=\w*[a-z])(?=\w*[013457])\w+"), re.compile(r"(?<=[a-z])[@$!|]+(?=[a-z])")
    some_mixed, words = re.compile("[a-z][013457]|[013457][a-z]").search, re.compile(r"[^\W_]+").findall

    def fold(text: str) -> list[str]:
        text = text.lower()
        if accent(text):
            if other(text):
                text = text.translate(HOMOGLYPHS)
            text = unicodedata.normalize("NFKC", text)
        if some_mixed(text):
            text = mixed.sub(lambda m: m[0].translate(DIGITS), text)
        return words(sign.sub(lambda m: m[0].translate(SIGNS), text))

    return fold


def terms_of(word: str) -> Iterator[str]:
    """A word, and its beginnings: what the lexicon may list. A space marks where a word begins and ends."""
    yield f" {word} "
    for n in range(3, min(len(word), 8)):
        yield f" {word[:n]}"


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, float, float, float] = (-6.0, 0.0, 0.0, 0.0)

    def matcher(self):
        """A function from a text to (number of words, sum of the weights matched, phrases around matches)."""
        import ahocorasick

        fold, find = folder(), ahocorasick.Automaton()
        for t, w in self.weights.items():
            find.add_word(t, (len(t), w))
        for t in self.exceptions:
            find.add_word(t, (len(t), 0.0))
        find.make_automaton()
        kinds = bool(len(find))

        def match(text: str) -> tuple[int, float, list[str], list[tuple[int, int, float]]]:
            words = fold(text)
            line = " " + " ".join(words) + " "
            hits = [(end - n + 1, end, w) for end, (n, w) in find.iter(line)] if kinds else []
            spared = [(a, b) for a, b, w in hits if w == 0.0]
            best: dict[int, tuple[int, float]] = {}
            for a, b, w in hits:  # at one word's start the heaviest term counts
                if w and not any(x <= a and b <= y + 1 for x, y in spared) and w > best.get(a, (0, 0.0))[1]:
                    best[a] = (b, w)
            return len(words), sum(w for _, w in best.values()), line, best

        return match

    def features(self, n_words: int, total: float) -> tuple[float, float, float]:
        """The weight, its share of the length, and the length."""
        return math.log1p(total), total / (n_words + 20), math.log1p(n_words)

    def score(self, n_words: int, total: float) -> float:
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], self.features(n_words, total), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _phrases(line: str, best: dict) -> set[str]:
    """Each matched word with the word before it, and with the one after."""
    out = set()
    for a in best:
        end = line.index(" ", a + 1)
        before, after = line.rfind(" ", 0, a), line.find(" ", end + 1)
        if before >= 0:
            out.add(line[before : end + 1])
        if after >= 0:
            out.add(line[a : after + 1])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a logistic regression of a few columns."""
    x = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return b


FOLDS = 3
NEAR = 0.2  # by how much a longer beginning has to outweigh a shorter one


def _lexicon(counts: list[tuple], size: tuple, least_docs: int, least_odds: float) -> dict[str, float]:
    """Weights of the terms in counts: (term, toxic and clean documents with it, its occurrences in either), against size, the same of all words. A weight is the log ratio of the term's rates among the words of toxic and of clean documents, less one standard error by documents, so that a term seen in few has to be all the clearer, and one that long clean texts hold once by chance but toxic ones over and over counts. Longer beginnings that say no more than a shorter one are left out."""
    heavy, (_, _, every_t, every_c) = {}, size
    for term, t, c, kt, kc in counts:
        if t >= least_docs:
            w = math.log((kt + 0.5) / (every_t + 1)) - math.log((kc + 0.5) / (every_c + 1)) - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
            if w >= least_odds:
                heavy[term] = w
    return {t: w for t, w in heavy.items() if not any(heavy.get(t[:n], 0) >= w - NEAR for n in range(4, len(t.rstrip())))}


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_docs: int = 3, least_odds: float = 3.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A lexicon and its scale from at most most_rows labelled documents, those whose ids' hashes are least.

    Terms are whole words and beginnings of words, weighted by how much oftener toxic
    documents use them than clean ones. Phrases of a matched word and a neighbour that
    clean documents have at least as often as toxic ones, relative to their numbers,
    become exceptions. A logistic scale is fitted on the weight's logarithm, its
    share of the text's length and the length, where each third of the sample is
    measured by a lexicon from the other two. The lexicon has every term that
    passes; only the sample is bounded, and with it what reaches the driver: terms of
    least_docs toxic documents in it, and three numbers a row.

    Rows whose label is null or whose crc32(id) mod 3 is 1 are never learned from.
    An id with several labels is toxic if one says so; documents that repeat an id
    count each. Without labels of both kinds the lexicon is empty and all texts have
    one low score.
    """
    spark = docs.sparkSession
    able = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and crc32(cast(_id as string)) % 3 <> 1")
    picked = written(able.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    rows = written(rows.select("_text", "y", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")), "sample").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs, uses, each = Counter(), Counter(), make()
            for b in batches:
                for t, y, f in zip(b.column("_text").to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist(), strict=True):
                    for x, k in each(t).items():
                        docs[x, f, y] += 1
                        uses[x, f, y] += k
            if docs:
                terms, folds, ys = zip(*docs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(folds, pa.int32()), pa.array(ys, pa.int32()), pa.array(docs.values(), pa.int64()), pa.array([uses[x] for x in docs], pa.int64())], ["term", "fold", "y", "n", "k"])

        n = lambda y, f, c: F.sum(F.when(F.col("fold").eqNullSafe(f) & (F.col("y") == y), F.col(c)).otherwise(0))
        every = [n(y, f, c).alias(f"{'ct'[y]}{c}{f}") for f in range(FOLDS) for y in (1, 0) for c in "nk"]
        return lambda df: df.mapInArrow(tidy(run), "term string, fold int, y int, n bigint, k bigint").groupBy("term").agg(*every)

    def terms():
        fold = folder()

        def each(text: str) -> Counter:
            words = fold(text)
            return Counter({"": len(words)}) + Counter(x for w in words for x in terms_of(w)) if words else Counter({"": 0})

        return each

    whole = lambda c: " + ".join(f"{c}n{k}" for k in range(FOLDS))
    counts = count(terms)(rows).where(f"term = '' or {whole('t')} >= {least_docs}").collect()  # of at most most_rows documents
    size = next((r for r in counts if not r.term), None)
    model = ToxicModel()
    total = lambda r, c, out=None: sum(r[f"{c}{k}"] for k in range(FOLDS) if k != out)
    if not size or not total(size, "tn") or not total(size, "cn"):
        return model

    def lexicon(out: int | None = None) -> dict[str, float]:
        of = lambda r: tuple(total(r, c, out) for c in ("tn", "cn", "tk", "ck"))
        return _lexicon([(r.term, *of(r)) for r in counts if r.term], of(size), least_docs, least_odds)

    model.weights = lexicon()

    def phrases(m=model):
        match = m.matcher()

        def each(text: str) -> Counter:
            _, _, line, best = match(text)
            return Counter(_phrases(line, best))

        return each

    nt, nc = total(size, "tn"), total(size, "cn")
    near = count(phrases)(rows).selectExpr("term", f"{whole('t')} as t", f"{whole('c')} as c").where(f"term <> '' and c >= 3 and (t + 0.5) / {nt + 1} <= (c + 0.5) / {nc + 1}")
    model.exceptions = sorted(r.term for r in near.collect())
    parts = [ToxicModel(lexicon(k), model.exceptions) for k in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = [m.matcher() for m in parts]
        for b in batches:
            x = [parts[f].features(*match[f](t)[:2]) for t, f in zip(b.column("_text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), *[pa.array([v[i] for v in x], pa.float64()) for i in range(3)]], ["y", "a", "b", "c"])

    points = rows.mapInArrow(tidy(measure), "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])  # at most most_rows, in one order
    model.coef = tuple(float(v) for v in _logistic(points[["a", "b", "c"]].to_numpy(), points["y"].to_numpy()))
    return model


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with score and predicted added.

    Words are folded, an Aho-Corasick automaton finds the lexicon's terms and the
    exception phrases in one pass, and terms inside an exception don't count. A null
    text counts as empty, which has the score of a text without hits. Nothing
    shuffles; other columns pass through, but for earlier ones of these two names.
    """
    docs = docs.drop("score", "predicted")

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = model.matcher()
        for texts in arrays:  # a slice of text at a time as Python strings
            batch = pa.RecordBatch.from_arrays([texts], ["t"])
            yield pa.array([model.score(*match(x or "")[:2]) for b in by_bytes(iter([batch]), "t") for x in b.column("t").to_pylist()], pa.float64())

    tidied = tidy(run)
    tidied.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as types, which the UDF's kind is read from
    score = F.arrow_udf(tidied, "double")
    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold. Only texts go to the workers and only the hashes of rejected ones come back, so rows with all their columns stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for b in by_bytes(batches, "t"):
            bad = [model.score(*match(x or "")[:2]) >= threshold for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h").filter(pa.array(bad))], ["h"])

    texts = docs.select(text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    return without(docs, written(texts.mapInArrow(tidy(run), "h binary").distinct(), "toxic", 2_000), text_hash(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
