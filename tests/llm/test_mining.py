"""Collocations, language ID and lexical search against brute force and held-out labels; what the pipeline's filters move."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglot.llm import collocations as C
from siglot.llm import language_id as I
from siglot.llm import lexical_search as S
from siglot.llm import queries
from siglot.llm.common import text_hash, without, written
from siglot.llm.decontam import contaminated, drop_contaminated

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# 11: collocations


def phrases(rows, longest=3, least=10, within=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        able = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in able.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in able.items():
            if not (p in longer and 100 * longer[p] >= within * a):
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(df, **how):
    return sorted(tuple(r) for r in C.collocations(df, **how).select(COLUMNS).collect())


def test_collocations_of_the_smallest_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = phrases([(r.lang, r.text) for r in d.select("lang", "text").collect()])
    assert want and sorted(tuple(r) for r in queries.op11_collocations(spark, sf).collect()) == want


def mixed_texts(n=150, seed=3):
    r = np.random.default_rng(seed)
    words = ["of", "the", "New", "york", "ÉTÉ", "été", "x\x0by", "a\tb", "z\x1cz", "漢字", "o'clock", "in"] + [f"w{i}" for i in range(30)]
    p = np.r_[[0.12] * 4, [0.02] * (len(words) - 4)]
    texts = ["".join(w + [" ", " ", " ", ". ", ",", "\n", "  "][r.integers(0, 7)] for w in r.choice(words, r.integers(0, 60), p=p / p.sum())) for _ in range(n)]
    langs = [["en", "fr", None, "und"][r.integers(0, 4)] for _ in range(n)]
    return list(zip(langs, texts, strict=True)) + [("en", None), (None, None), ("fr", ""), ("de", "alone"), ("en", "of the of the. " * 4000), ("en", "of the of the. " * 40)]


def test_collocations_over_many_ranges_and_slices(spark, monkeypatch):
    """Slices of a few texts and ranges of a few suffixes: what many tasks hold in parts is still counted once."""
    monkeypatch.setattr(C, "SLICE", 700)
    monkeypatch.setattr(C, "RANGE", 400)
    rows = mixed_texts()
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, n int, phrase string").repartition(6)
    bounds = C._bounds(d.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), 3)
    assert sum(map(len, bounds.values())) > 20
    assert mined(d) == phrases(rows)
    assert mined(d, longest=4, least=6, within=80, top=15) == phrases(rows, 4, 6, 80, 15)
    assert mined(d, longest=2) == phrases(rows, 2)


def test_no_collocations(spark):
    d = spark.createDataFrame([], "lang string, text string")
    assert mined(d) == [] and mined(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")) == []


def test_equal_partitions_by_counting():
    r = np.random.default_rng(5)
    for least in (1, 4, 40):
        rows = r.integers(-1, 6, (400, 3))
        rows[rows[:, 0] < 0, 1] = -1
        rows[rows[:, 1] < 0, 2] = -1
        weight = r.integers(1, 5, 400)
        want = [collections.Counter() for _ in range(3)]
        for row, w in zip(rows, weight, strict=True):
            for k in range(3):
                if (row[: k + 1] >= 0).all():
                    want[k][tuple(row[: k + 1])] += int(w)
        got = {depth: {tuple(rows[i, :depth]): int(f) for i, f in zip(at, total, strict=True)} for depth, at, total in C.equal_partitions(list(rows.T), weight, least)}
        assert got == {k + 1: {p: n for p, n in c.items() if n >= least} for k, c in enumerate(want) if any(n >= least for n in c.values())}


# 12: language ID


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    p = queries.op12_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id]).all() and p.score.between(0, 1).all()
    h = p[p.held_out & p.lang.notna() & p.text.str.contains("[a-z]", na=False)]
    assert len(h) > 150 and (h.lang == h.lang_pred).mean() > 0.985


def test_scores_by_definition(spark):
    """Every n-gram counted by hand, hashes aside: one bucket for each."""
    rows = [(1, "aa", "aba aba"), (2, "bb", "bcb, BCB!"), (3, "aa", "ab"), (4, "bb", None), (7, None, "zzz"), (8, "aa", "abba ")]
    d = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], "doc_id int, lang string, text string")
    model = I.learn(d, sizes=(1, 2), buckets=1 << 20)
    asked = ["ab cb", "bcbc", "q", " ab  "]
    best, score = model.score(asked)

    def grams(t):
        t = " " + " ".join(re.findall("[a-z]+", t.lower())) + " "
        return collections.Counter(t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1))

    seen, docs = {"aa": collections.Counter(), "bb": collections.Counter()}, collections.Counter()
    for _, lang, text in [tuple(r) for r in d.collect()]:
        if lang and text:
            seen[lang] += grams(text)
            docs[lang] += 1
    for t, b, s in zip(asked, best, score, strict=True):
        log = {k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((c[g] + 0.05) / (sum(c.values()) + 0.05 * (1 << 20))) for g, n in grams(t).items()) for k, c in seen.items()}
        top = max(log, key=log.get)
        assert model.languages[b] == top and s == pytest.approx(1 / sum(math.exp(v - log[top]) for v in log.values()), rel=1e-3)


def test_odd_texts_of_no_language(spark):
    texts = [None, "", "  ", "1234 -- !", "½ ² ①", "漢字", "é", "a" * 300_000, "text"]
    d = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(None, "some", "x", 0.1)], "doc_id int, text string, lang_pred string, score double")
    train = spark.createDataFrame([(i, "en", "some text of words") for i in range(20)], "doc_id int, lang string, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in I.language_id(d, I.learn(train)).collect()}
    assert len(got) == 10 and [got[i] for i in range(5)] == [("und", 0.0)] * 5 and all(got[i] == ("en", 1.0) for i in (5, 6, 7, 8, None))
    none = I.learn(train.where("false"))
    assert {r.lang_pred for r in I.language_id(d, none).collect()} == {"und"} and I.language_id(d.where("false"), I.learn(train)).count() == 0


def test_a_bounded_sample_teaches(spark):
    train = spark.createDataFrame([(i, "en" if i % 3 else "fr", "the and" if i % 3 else "le et") for i in range(300)], "doc_id int, lang string, text string")
    m = I.learn(train, most_per_lang=10)
    assert np.exp(m.prior) == pytest.approx([0.5, 0.5]) and m.languages == ["en", "fr"]
    assert len(I.learn(train, buckets=1 << 12, most_cells=1 << 10).weights) == 1 << 9  # halved to fit


# 13: lexical search


def ranked(docs, items, top=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall
    c = [(d, collections.Counter(term((t or "").translate(UPPER)))) for d, t in docs]
    c = [(d, x, sum(x.values())) for d, x in c if x]
    n_docs, n_terms = len(c), sum(n for *_, n in c)
    df, out = collections.Counter(t for _, x, _ in c for t in x), []
    for item, text in items:
        q = collections.Counter(term((text or "").translate(UPPER)))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scores = []
        for d, x, n in c:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(k * w[t] * (1000000000 * x[t] // (1000 * x[t] + 12 * m)) for t, k in q.items() if t in x)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_of_the_smallest_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert plain(tuple(r) for r in queries.op13_lexical_search(spark, sf).collect()) == plain(ranked(docs, items))


def small_world(seed, n=400):
    r = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(40)] + ["É", "é", "漢", "x-y", "A_b"]
    make = lambda k: " ".join(r.choice(words, k, p=np.arange(1, 46) / 1035))
    docs = [(i, make(r.integers(0, 30))) for i in range(n)] + [(1000 + i, "t1 t2 t3 t3") for i in range(60)] + [(None, "t1 t2 t3 t3"), (None, None), (5, "t44"), (5, "t44"), (2000, ""), (2001, "--- !"), (2002, "t7 " * 5000)]
    items = [(i, make(r.integers(1, 12))) for i in range(25)] + [(None, "t1 t2"), (3, "t3 t3 t3 t1"), (3, "t3"), (70, None), (71, ""), (72, "unseen words")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_brute_force(spark, monkeypatch, seed):
    """Small leaves and lots, several blocks of items, ties, repeated rows, null ids on both sides, and clashing columns."""
    monkeypatch.setattr(S, "LEAF", 4)
    monkeypatch.setattr(S, "LOT", 50)
    monkeypatch.setattr(S, "PART", 100)
    docs, items = small_world(seed)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, rank int, _id int").repartition(5)
    b = spark.createDataFrame([(*r, 1.0) for r in items], "item_id int, text string, score double")
    for top, size in ((20, 256), (3, 7)):
        got = [tuple(r) for r in S.lexical_search(d, b, top, block_items=size).collect()]
        assert plain(got) == plain(ranked(docs, items, top))
    assert S.lexical_search(d.where("false"), b).count() == 0 == S.lexical_search(d, b.where("false")).count()


def test_bounds_hold_and_prune():
    """No document scores over the bound of any node above it, and nodes are left out."""
    r = np.random.default_rng(9)
    vectors = sorted((bytes(np.array(sorted(r.choice(60, r.integers(1, 20), replace=False)), ">u4")), i) for i in range(900))
    tfs = [bytes(r.integers(1, 5, len(v) // 4).astype("<u4")) for v, _ in vectors]
    m, weight = r.integers(76, 300, 900), np.arange(100, 6100, 100)
    tree = S.DocumentTree([v for v, _ in vectors], tfs, m, weight)
    repeats = (r.random((12, 60)) < 0.08).astype(np.int64) * r.integers(1, 3, (12, 60))
    bounds = tree.bounds(repeats)
    every = np.array([[int((tree.gain[s : s + n] * q[tree.ranks[s : s + n]]).sum()) for s, n in zip(tree.starts, tree.lens, strict=True)] for q in repeats])
    for node, (lo, hi) in enumerate(tree.ranges):
        assert (every[:, lo:hi].max(1) <= bounds[node]).all()
        assert sorted(tree.ranges[c] for c in tree.children[node]) == [tree.ranges[c] for c in tree.children[node]]
    best, seen = S.Best(repeats, 5), []
    best.ids = list(range(900))
    add = best.add
    best.add = lambda *a: (seen.append(a), add(*a))
    tree.search(best)
    for q, found in zip(every, best.found, strict=True):
        want = sorted((-int(s), i) for i, s in enumerate(q) if s > 0)[:5]
        assert [(s, i) for s, _, i in found] == want
    assert len(seen) < every.size / 4


# the pipeline's filters


def test_rows_outside_the_filter_stay_where_they_are(spark):
    d = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("x").alias("h"))
    bad = written(d.where("id % 100 = 3").select(text_hash(F.col("text")).alias("h")), "bad")
    out = without(d, bad, text_hash(F.col("text")))
    assert {r.id for r in out.collect()} == {i for i in range(1000) if i % 100 != 3} and out.columns == d.columns
    first = out._jdf.queryExecution().optimizedPlan().children().head().toString()  # what passes straight through
    assert "Join" not in first and "Filter" in first


def test_items_without_an_id_count(spark):
    text = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of the kind here at all"), (None, text)], "doc_id int, text string")
    b = spark.createDataFrame([(None, text), (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (4, text)], "item_id int, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in contaminated(d, b).collect()))
    assert got == [(0, 0), (0, 4), (1, 0), (1, 4)]
    assert [r.doc_id for r in drop_contaminated(d, b).collect()] == [2]
