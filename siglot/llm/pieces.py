"""Pieces of text that a byte-level BPE tokenizer encodes independently of each other.

The tokenizer's pattern matches left to right and never looks back; a match that
begins with a space goes on with letters, digits or signs, and of a run of white
space the last character is left to what follows. So a text may be cut before any
space but one with white space (or nothing) on its right and white space on its
left. Texts with white space whose class differs between pattern libraries are
left whole. A text, or else a piece, of Latin letters and ASCII signs falls further
into words and what is between them, and a word is one match of the pattern, which
the library's model encodes directly.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from siglot.llm.common import kept

ODD = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
KEEP = 400_000  # pieces, and words, remembered in a process, at most
LONG = 2_000  # characters of a text part that isn't remembered


def unsafe() -> Callable[[str], bool]:
    """Whether a text has to be encoded as a whole."""
    odd, run = re.compile(ODD).search, re.compile(r"\s (?:\s|\Z)").search
    return lambda t: bool(odd(t) or (("  " in t or "\n " in t or "\t " in t or "\r " in t or t[-1:] == " ") and run(t)))


class _Known(dict):
    """A bounded memory of what `make` gives: a full half becomes the older one, from which what is asked for again comes back, so that frequent keys stay."""

    def __init__(self, make: Callable, most: int = KEEP):
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key: str):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceEncoder:
    """The ids of texts, piece by piece; made(ids) stands for a piece and joined(parts) for a whole."""

    def __init__(self, path: str, made: Callable, joined: Callable):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.made, self.joined = made, joined
        self.whole = unsafe()
        self.plain = re.compile(rf"[\n -&(-~{LETTERS}]*").fullmatch  # no apostrophe, which may belong to the letters after it
        self.parts = re.compile(rf" ?[{LETTERS}]+|(?:[^{LETTERS} ]+| (?![{LETTERS}]))+").findall
        self.word = re.compile(rf" ?[{LETTERS}]+").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, in byte-level BPE
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.words, self.later, self.first = _Known(self._word, 2 * KEEP), _Known(self._later), _Known(self._piece)

    @classmethod
    def of_process(cls, path: str, made: Callable, joined: Callable) -> PieceEncoder:
        """One encoder for all tasks that a Python worker runs."""
        return kept((path, made.__name__), lambda: cls(path, made, joined))

    def _whole(self, text: str):
        return self.made(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, w: str):
        if self.word(w):
            shown = w.replace(" ", self.byte[32]) if w.isascii() else "".join(map(self.byte.__getitem__, w.encode("utf-8")))
            return self.made([t.id for t in self.tok.model.tokenize(shown)])
        return self._whole(w)

    def _later(self, p: str):
        if p.isascii() and p.isalpha():
            return self.made([t.id for t in self.tok.model.tokenize(self.byte[32] + p)])
        return self._piece(" " + p)

    def _falls(self, p: str) -> bool:
        """Whether p has no special strings, runs of white space, or scripts whose classes the library knows best."""
        return not ("<|" in p or "\n\n" in p or " \n" in p) and bool(self.plain(p))

    def _piece(self, p: str):
        if not self._falls(p):
            return self._whole(p)
        return self.joined([self.later[w[1:]] if w[0] == " " and w.isascii() and w[1:].isalpha() else self.words[w] for w in self.parts(p)])

    def text(self, t: str) -> list:
        """What stands for the pieces of t, in order."""
        if self.whole(t):
            return [self._whole(t)]
        if self._falls(t):
            return list(map(self.words.__getitem__, self.parts(t)))
        head, *rest = t.split(" ")
        out = list(map(self.later.__getitem__, rest))
        if head:
            out.insert(0, self.first[head])
        return out


def two_bytes(ids: list[int]) -> bytes:
    import struct

    return struct.pack(f"<{len(ids)}H", *ids)
