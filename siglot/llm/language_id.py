"""Language ID: multinomial naive Bayes over hashed character n-grams (operator 12)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, fresh, kept, tidy, written

UNKNOWN = "und"
SLICE = 400_000  # bytes of text whose n-grams are counted at a time


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter():
    """Whether a text has a letter of any script."""
    plain = re.compile("[A-Za-z]").search
    return lambda text: bool(plain(text)) or any(map(str.isalpha, text))


def sparse_counts(texts: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the hashed n-grams of texts, in order of row and bucket.

    Letters are lower-cased, each run of other characters counts as one gap, and so
    do a text's two ends: n-grams know where words begin and end, but nothing of
    digits, signs or layout.
    """
    letter = kept(("letters",), _letters)
    lowered = [t.lower() for t in texts]
    lens = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    chars = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lens)
    is_letter = letter[chars]
    first = np.ones(len(chars), bool)  # of a run of gaps; each row has its own
    first[1:] = is_letter[1:] | is_letter[:-1] | (row[1:] != row[:-1])
    chars, row = np.where(is_letter, chars, 32)[first].astype(np.uint64), row[first]
    h, keys = np.zeros(len(chars), np.uint64), []
    for n in range(1, max(sizes) + 1):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        if n in sizes:
            whole = row[: len(h)] == row[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append((row[: len(h)] * buckets + (mixed >> np.uint64(33)).astype(np.int64) % buckets)[whole])
    at, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
    return at // buckets, at % buckets, counts


@dataclass
class LanguageModel:
    """languages, and the logarithms of their shares of the documents and of each bucket's probability."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # one row a bucket, one column a language
    sizes: tuple[int, ...]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language's place and its posterior probability."""
        row, bucket, n = sparse_counts(texts, self.sizes, len(self.weights))
        total = np.tile(self.prior, (len(texts), 1))
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[starts]] += np.add.reduceat(self.weights[bucket] * n[:, None], starts)  # in doubles
        best = total.argmax(1)
        return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, most_per_lang: int = 2_000, smoothing: float = 0.05, most_cells: int = 1 << 22) -> LanguageModel:
    """Naive Bayes from the whole texts of at most most_per_lang documents a language, those whose ids' hashes are least.

    Documents with a null language or text and those held out (crc32(id) mod 5 is 0)
    teach nothing. N-grams are counted per task and added up by bucket; what reaches
    the driver has at most languages x buckets rows, and buckets are halved until
    that is at most most_cells, so its size doesn't grow with the corpus. Without
    any document to learn from there are no languages.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("_text")).where("lang is not null and _text is not null").where(~held_out("_id"))
    picked = usable.select("_id", "lang", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(64)).alias("_part"))
    for keys in (["lang", "_part"], ["lang"]):  # first within parts of a language, so that no task gets all its documents
        first = Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id")
        picked = picked.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most_per_lang).drop("_k")
    picked = written(picked.select("_id", "lang").distinct(), "languages")
    shares = {r.lang: r["count"] for r in picked.groupBy("lang").count().collect()}
    languages = sorted(shares)
    while len(languages) * buckets > most_cells:
        buckets //= 2
    code = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, np.int64)
        for b in by_bytes(batches, "_text", SLICE):
            row, bucket, n = sparse_counts(b.column("_text").to_pylist(), sizes, buckets)
            lang = np.array([code[x] for x in b.column("lang").to_pylist()], np.int64)
            at, which = np.unique(lang[row] * buckets + bucket, return_inverse=True)
            total[at] += np.bincount(which, n, len(at)).astype(np.int64)
        for start in range(0, len(total), 1 << 16):
            at = np.flatnonzero(total[start : start + (1 << 16)]) + start
            yield pa.RecordBatch.from_arrays([pa.array(at // buckets, pa.int32()), pa.array(at % buckets, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    counted = usable.join(picked, ["_id", "lang"], "left_semi").select("lang", "_text").mapInArrow(tidy(count, remembers=True), "lang int, bucket int, n bigint")
    seen = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((buckets, len(languages)), smoothing)
    table[seen["bucket"].to_numpy(), seen["lang"].to_numpy()] += seen["n"].to_numpy()
    prior = np.array([shares[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()) if languages else prior, np.log(table / table.sum(0)).astype(np.float32), sizes)


def language_id(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row of docs with lang_pred and score added.

    The model's matrix goes to each executor once; texts are scored a slice at a time,
    as sparse rows of n-gram counts times the matrix. The score is the posterior
    probability of the language predicted. A null text, and one without a letter of
    any script, is `und` with score 0; so is every text where nothing was learned.
    Of equally likely languages the first by name is predicted. Nothing shuffles; other columns pass through, but for
    earlier ones of these two names.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.weights, model.sizes))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, able = LanguageModel(*sent.value), has_letter()
        for array in arrays:
            names, scores = [], []
            for b in by_bytes(iter([pa.RecordBatch.from_arrays([array], ["t"])]), "t", SLICE):
                texts = b.column("t").to_pylist()
                known = [bool(m.languages) and t is not None and able(t) for t in texts]
                best, score = m.score([t for t, k in zip(texts, known, strict=True) if k]) if any(known) else ((), ())
                found = iter(zip(best, score, strict=True))
                for k in known:
                    lang, p = next(found) if k else (None, 0.0)
                    names.append(UNKNOWN if lang is None else m.languages[lang])
                    scores.append(float(p))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    tidied = tidy(run, remembers=True)
    tidied.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    guess = F.arrow_udf(tidied, "lang_pred string, score double")
    name = fresh(docs, "guess")
    return docs.withColumn(name, guess(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{name}.lang_pred", f"{name}.score")
