"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding (operator 5)."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglot.llm.common import by_bytes, kept, tidy

KEEP = 60_000  # pieces, and pairs of tokens, remembered in a process


class TrieBpe:
    """Encodes words by the last token of each of their prefixes.

    In BPE the encoding of a text's prefix up to a token border is the prefix of its
    encoding, so the last token of every prefix says all: it is the one vocabulary
    entry t ending there for which the encoding of what comes before t ends in a
    token that stays unmerged next to t. Words are walked in sorted order, which is
    the depth-first order of their trie; a prefix's state is computed when a word
    below it first asks for it, and the states of the prefix that a word shares with
    the one before it stay on the stack.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: token -> (rank of the merge that makes it, left part, right part); base symbols aren't here
        self.parts: dict[str, tuple[int, str, str]] = {}
        #: ranks of further merges that make a token which another one makes first
        self.more: dict[tuple[str, str], int] = {}
        one = {t: t for t in self.vocab}  # a string that comes again is kept once
        for r, m in enumerate(model.pop("merges")):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, t = one.get(a, a), one.get(b, b), one.get(a + b, a + b)
            if self.parts.setdefault(t, (r, a, b))[1] != a:
                self.more[a, b] = r
        self.longest = max(map(len, self.vocab))
        self.tokens = {t for t in self.vocab if t in self.parts or len(t.removesuffix(self.end) or t) == 1}
        self.stays: dict[tuple[str, str], bool] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, in byte-level BPE
        byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.byte = "".join(byte[b] for b in range(256))

    def rank(self, a: str, b: str, none: int) -> int:
        """The rank of the merge of a and b."""
        made = self.parts.get(a + b)
        return none if made is None else made[0] if made[1] == a else self.more.get((a, b), none)

    def unmerged(self, a: str, b: str) -> bool:
        """Whether tokens a and b, next to each other, are what BPE makes of a + b.

        Merges are undone from the latest back to the first. Between two undone
        merges the symbols at the border stood side by side; had they had a merge of
        lower rank than the one undone, BPE would have taken it. At the same rank the
        left one goes first.
        """
        if (known := self.stays.get((a, b))) is not None:
            return known
        x, y, least, out = a, b, 1 << 60, True
        while True:
            if self.rank(x, y, least) < least:
                out = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or (px is not None and px[0] > py[0]):
                least, x = px[0], px[2]
            else:
                least, y = py[0] + 1, py[1]
        if len(self.stays) > KEEP:
            self.stays.clear()
        self.stays[a, b] = out
        return out

    def symbols(self, word: str) -> str:
        return codecs.charmap_decode(word.encode("utf-8"), "strict", self.byte)[0]

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Distinct words of byte-level symbols (the last one of a word also carries the end mark) with their tokens."""
        tokens, end = self.tokens, self.end
        before: str = ""
        last: list[str | None] = [""]  # last[i]: last token of the first i symbols of the word before, once it was asked for
        for w in sorted(words):
            if w + end in tokens:
                yield w, [w + end]
                continue
            n, most = 0, min(len(w), len(before))
            while n < most and w[n] == before[n]:
                n += 1
            del last[n + 1 :]
            last += [None] * (len(w) - n)
            before = w
            if len(w) > 200:  # from the front, as asking from the back would nest as deep
                for i in range(n, len(w) + 1):
                    if last[i] is None:
                        last[i] = self._last(w, i, "", last)
            t, i, back, cut = self._last(w, len(w), end, last), len(w), [], len(end)
            while True:
                back.append(t)
                i -= len(t) - cut
                if i <= 0:
                    break
                t, cut = last[i], 0
            back.reverse()
            yield w, back

    def _last(self, w: str, i: int, end: str, last: list[str | None]) -> str:
        tokens, stays = self.tokens, self.stays
        for j in range(i - self.longest if i > self.longest else 0, i):
            t = w[j:i] + end
            if t in tokens:
                if not j:
                    return t
                x = last[j]
                if x is None:
                    x = last[j] = self._last(w, j, "", last)
                fits = stays.get((x, t))
                if fits or (fits is None and self.unmerged(x, t)):
                    return t
        raise ValueError(f"no encoding for {w[:i]!r}")


class TextEncoder:
    """Texts to ids, and ids to text, of a tokenizers file whose words are lower-cased and split by a pattern."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.bpe = path, TrieBpe(spec)
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")")
        self.control = re.compile("[\x1c-\x1f]").search  # str.split() cuts there, the tokenizer's pattern doesn't
        self.plain = re.compile("[\t-\r -\u017f\u2010-\u2026\u20ac]*").fullmatch
        #: the ids as u32 of whole pieces and, as the library joins tokens for a file without a decoder, their tokens with a space behind each; and both of words that aren't ASCII letters in lower case, as those are pieces of their own
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    @cached_property
    def tok(self):
        """The library's own tokenizer, which takes as much memory as the tries do: loaded where a rare script first asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def of_process(cls, path: str) -> TextEncoder:
        """One encoder for all tasks that a Python worker runs."""
        return kept((path, "trie"), lambda: cls(path))

    def _words(self, piece: str) -> list[str | tuple[bytes, bytes]]:
        """What a piece without white space is made of: words as byte-level symbols, and ids and text of special strings."""
        out: list[str | tuple[bytes, bytes]] = []
        for k, part in enumerate(self.special.split(piece) if "<|" in piece else [piece]):
            if k % 2:
                out.append((struct.pack("<I", self.bpe.special[part]), part.encode("utf-8") + b" "))
            elif part.isascii():  # printable ASCII stands for itself among the byte-level symbols
                out += self.find(part.lower()) if part.isprintable() else map(self.bpe.symbols, self.find(part.lower()))
            elif self.plain(part):
                out += map(self.bpe.symbols, self.find(unicodedata.normalize("NFC", part).lower()))
            elif part:  # rarer scripts: the library's own tables decide on composition, case and classes
                out += [s for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text's pieces, all of which stand in self.ids and self.text until the next call."""
        cut = [re.split("[ \t\n\r\x0b\x0c]+", t) if self.control(t) else t.split() for t in texts]
        met = set().union(*cut)
        ids, text, words = self.ids, self.text, self.words
        if len(ids) > KEEP:  # those that come again now stay
            old_ids, old_text = ids, text
            again = met.intersection(ids)
            ids = self.ids = {p: old_ids[p] for p in again}
            text = self.text = {p: old_text[p] for p in again}
        if len(words) > KEEP // 2:
            words.clear()
        new = met.difference(ids)
        letters = {p: p.lower() for p in new if p.isascii() and p.isalpha()}  # one word, which stands for itself
        mixed = {p: self._words(p) for p in new.difference(letters)}
        unknown = set(letters.values()).union(*[[w for w in ws if isinstance(w, str)] for ws in mixed.values()])
        known = self.bpe.vocab.__getitem__
        for w, tokens in self.bpe.encode(unknown.difference(ids, words)):
            i, t = struct.pack(f"<{len(tokens)}I", *map(known, tokens)), " ".join(tokens).encode("utf-8") + b" "
            if w.isascii() and w.isalpha():
                ids[w], text[w] = i, t
            else:
                words[w] = i, t
        for p, w in letters.items():
            ids[p], text[p] = ids[w], text[w]
        for p, ws in mixed.items():
            parts = [w if isinstance(w, tuple) else words.get(w) or (ids[w], text[w]) for w in ws]
            ids[p], text[p] = parts[0] if len(parts) == 1 else (b"".join([i for i, _ in parts]), b"".join([t for _, t in parts]))
        return cut

    def batch(self, texts: list[str]) -> list[list[tuple[bytes, int, str]]]:
        """For each text its pieces' (ids as u32, their count, decoded text)."""
        return [[(self.ids[p], len(self.ids[p]) // 4, self.text[p][:-1].decode("utf-8")) for p in ps] for ps in self.pieces(texts)]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded.

    Nothing shuffles; a task builds the trie of the words that are new in an Arrow
    slice and remembers a bounded number of encodings. A null text counts as empty,
    a null id stays null, repeated rows each give a row, and no other column is
    read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in by_bytes(batches, "_text", 1_000_000):
            enc = enc or TextEncoder.of_process(tokenizer)
            n, sha, dec, ids, text = [], [], [], [], []
            for ps in enc.pieces(pc.fill_null(b.column("_text"), "").to_pylist()):
                raw = b"".join(map(enc.ids.__getitem__, ps))
                back = b"".join(map(enc.text.__getitem__, ps))[:-1]
                n.append(len(raw) // 4)
                sha.append(hashlib.sha256(raw).hexdigest())
                dec.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(struct.unpack(f"<{len(raw) // 4}I", raw))
                    text.append(back.decode("utf-8"))
            cols = [b.column("_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(encode, remembers=True), schema).withColumnRenamed("_id", id_col)
