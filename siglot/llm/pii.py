"""Personal data replaced by keyed surrogates (operator 3)."""

from __future__ import annotations

import hmac
import math
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from siglot.llm.common import by_bytes, fresh, text_hash, tidy, written

# Titles by script and gender (m, f, n: either), and given names and family name parts to draw from.
TITLES = {
    "latin": {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "n": ["Dr", "Prof"]},
    "cyrillic": {"m": ["господин"], "f": ["госпожа"], "n": ["доктор"]},
    "greek": {"m": ["κύριος"], "f": ["κυρία"], "n": ["γιατρός"]},
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Henri", "Jonas", "Lucas", "Oscar", "Paul", "Victor"],
    ("latin", "f"): ["Alba", "Clara", "Diana", "Emma", "Flora", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Sofia"],
    ("latin", "n"): ["Alex", "Andrea", "Charlie", "Dominique", "Kim", "Noa", "Robin", "Sacha"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Роман"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος", "Σπύρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία", "Ειρήνη"],
    ("greek", "n"): ["Άγγελος", "Χάρις"],
}
FAMILY = {
    "latin": ["ba", "cor", "del", "fen", "gar", "hol", "lin", "mar", "nor", "pel", "ros", "san", "tor", "vel", "wen", "zam"],
    "cyrillic": ["бар", "вол", "гор", "дим", "кор", "лев", "мор", "нов", "пол", "сер", "тар", "фед"],
    "greek": ["βαρ", "γαλ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "σαρ", "τσα"],
}
SCRIPTS = {"latin": "A-Za-zÀ-ÖØ-öø-ſ", "cyrillic": "А-Яа-яЁё", "greek": "Ά-Ͽ"}
ENDINGS = {  # of further given names, by gender
    "latin": {"m": "o", "f": "a", "n": "is"}, "cyrillic": {"m": "ан", "f": "ина", "n": "ша"}, "greek": {"m": "ος", "f": "ία", "n": "ις"},
}
# Calling codes of one and of two digits; all others have three.
CODES = {1: {"1", "7"}, 2: set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())}

EMAIL = r"[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"(?<![\w.+])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w]|\.\d)"
SECRET = r"\bAKIA[A-Z0-9]{16}\b|(?<=password=)[^\s\"']{6,}|(?<=token = \")[0-9A-Za-z]{16,}(?=\")"


def _name_pattern(script: str) -> str:
    upper = {"latin": "A-ZÀ-ÖØ-Þ", "cyrillic": "А-ЯЁ", "greek": "Ά-Ϋ"}[script]
    titles = "|".join(re.escape(t) for g in TITLES[script].values() for t in sorted(g, key=len, reverse=True))
    one = rf"(?!(?:{titles})\b)[{upper}][{SCRIPTS[script]}'’-]+"
    return rf"\b({titles})(\.? )({one}(?: {one}){{0,2}})"


Unit = tuple[str, str, str]  # kind, canonical value, gender ("" but for given names)


def _name_units(script: str, gender: str, name: str) -> list[Unit]:
    """The units of a name: the pieces of its last word are family names, those before it given ones; single letters stand."""
    *given, family = name.lower().split(" ")
    cut = lambda w: [x for x in re.split("[-'’]", w) if len(x) > 1]
    return [(f"given {script}", x, gender) for w in given for x in cut(w)] + [(f"family {script}", x, "") for x in cut(family)]


class Finder:
    """(start, end, kind, units) of the entities of a text, left to right and without overlap.

    A unit is what keeps one surrogate everywhere: a number, an address's local part
    with its domain, a domain, and each piece of a name. So the same person with another
    title, with the family name alone or in another form of writing is the same unit
    again. A name is found by its title; its other mentions in the text, whole or the
    family name alone, are entities as well, and share the gender that a title gives.
    """

    def __init__(self):
        self.simple = [(k, re.compile(p)) for k, p in (("card", CARD), ("ip", IP), ("phone", PHONE), ("secret", SECRET))]
        self.email, self.digit = re.compile(EMAIL), re.compile(r"\d").search
        self.local = re.compile(r"[A-Za-z0-9_.+-]{0,64}\Z")
        self.names = [(s, re.compile(_name_pattern(s))) for s in SCRIPTS]
        self.other = re.compile("[Ͱ-ӿ]").search
        self.gender = {t: g for by in TITLES.values() for g, ts in by.items() for t in ts}

    def _names(self, t: str, script: str, pattern: re.Pattern) -> list[tuple[int, int, str, list[Unit]]]:
        titled = [(m.start(3), m.end(3), m[3], self.gender[m[1]]) for m in pattern.finditer(t)]
        if not titled:
            return []
        known: dict[str, set[str]] = {}  # genders of whole names, from all their titles in the text
        for _, _, name, g in titled:
            known.setdefault(name.lower(), set()).add(g)
        gender = lambda name: (known[name.lower()] - {"n"} or {"n"}).pop() if len(known[name.lower()] - {"n"}) < 2 else "n"
        forms = {name: name for _, _, name, _ in titled} | {name.split(" ")[-1]: name.split(" ")[-1] for _, _, name, _ in titled}
        again = re.compile(rf"(?<![\w'’-])(?:{'|'.join(re.escape(f) for f in sorted(forms, key=len, reverse=True))})(?![\w'’-])")
        out = [(a, b, name, gender(name)) for a, b, name, _ in titled]
        out += [(m.start(), m.end(), m[0], gender(m[0]) if m[0].lower() in known else "n") for m in again.finditer(t)]
        return [(a, b, "name", _name_units(script, g, name)) for a, b, name, g in out]

    def __call__(self, t: str) -> list[tuple[int, int, str, list[Unit]]]:
        out: list[tuple[int, int, str, list[Unit]]] = []
        at = t.find("@")
        while at >= 0:  # from the sign outwards: no scan of every word
            m = self.email.match(t, at - len(self.local.search(t[max(0, at - 64) : at])[0]))
            if m and m.end() > at:
                end = m.end() - (len(m[0]) - len(m[0].rstrip(".-")))
                local, domain = t[m.start() : end].lower().split("@")
                out.append((m.start(), end, "email", [("local " + domain, local, ""), ("domain", domain, "")]))
                at = m.end() - 1
            at = t.find("@", at + 1)
        if self.digit(t):
            for kind, p in self.simple[:3]:
                for m in p.finditer(t):
                    digits = re.sub(r"\D", "", m[0])
                    out.append((m.start(), m.end(), kind, [(kind, m[0] if kind == "ip" else "+" * m[0].startswith("+") + digits, "")]))
        if "AKIA" in t or "password=" in t or "token = " in t:
            out += [(m.start(), m.end(), "secret", [("secret", m[0], "")]) for m in self.simple[3][1].finditer(t)]
        for script, p in self.names if self.other(t) else self.names[:1]:
            out += self._names(t, script, p)
        out.sort(key=lambda x: (x[0], -x[1]))
        kept, end = [], 0
        for x in out:
            if x[0] >= end:
                kept.append(x)
                end = x[1]
        return kept


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """Bytes that depend on the key and the entity alone."""
    k = 0
    while True:
        yield from hmac.digest(key, f"{kind}\x1f{value}\x1f{attempt}\x1f{k}".encode(), "sha256")
        k += 1


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _code(value: str) -> int:
    """How many characters of a number stay: the plus sign and the calling code."""
    if not value.startswith("+"):
        return 0
    return 1 + next((k for k in (1, 2) if value[1 : 1 + k] in CODES[k]), 3)


def _address(value: str, draw) -> str:
    """An address of the same class: private ranges and the loopback stay what they are, others are public."""
    old, new = list(map(int, value.split("."))), [draw(256) for _ in range(3)] + [1 + draw(254)]
    fixed = 1 if old[0] in (0, 10, 127) or old[0] >= 224 else 2 if old[:2] in ([192, 168], [169, 254]) else 0
    if old[0] == 172 and 16 <= old[1] < 32:
        return f"172.{16 + draw(16)}.{new[2]}.{new[3]}"
    if not fixed:
        first = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
        new[0] = first[draw(len(first))]
    return ".".join(map(str, old[:fixed] + new[fixed:]))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FORMS = ("card", "phone", "secret", "domain", "local", "ip")  # kinds whose surrogates have the value's own form


def _address_class(value: str) -> tuple[str, int, int]:
    """(name, octets that stay, addresses that are drawn from) of the range that an address belongs to."""
    a, b = map(int, value.split(".")[:2])
    if a == 172 and 16 <= b < 32:
        return "172.16", 1, 16 * 256 * 254
    if (a, b) in ((192, 168), (169, 254)):
        return f"{a}.{b}", 2, 256 * 254
    return (str(a), 1, 256 * 256 * 254) if a in (0, 10, 127) or a >= 224 else ("public", 0, 219 * 256 * 256 * 254)


def _places(kind: str, value: str) -> list[str]:
    """For each character of a value those that a surrogate may have there; one where it stays."""
    head = _code(value) if kind == "phone" else 4 if kind == "secret" and value.startswith("AKIA") else 0
    tail = len(value) - value.rfind(".") if kind == "domain" else 0
    free = lambda c: DIGITS if c.isdigit() and c.isascii() else LOWER if c in LOWER else UPPER if c in UPPER else c
    out = [c if i < head or i >= len(value) - tail else free(c) for i, c in enumerate(value)]
    if kind == "card" and _luhn(value) == 0:
        out[-1] = ""  # what the others make it
    return out


def space(kind: str, value: str) -> tuple[str, float]:
    """(name, size) of the set of values that surrogates of a value come from. Those of different names have no value in common; names have no bound, as further draws are longer."""
    what = kind.partition(" ")[0]
    if what not in FORMS:
        return "", float("inf")
    if what == "ip":
        name, _, size = _address_class(value)
        return f"{kind}\x1f{name}", float(size)
    places = _places(what, value)
    hexes = what == "secret" and re.fullmatch("[0-9a-f]+", value)
    size = 1.0
    for p in places:
        size *= 6 if hexes and p == LOWER else max(1, len(p))
    size *= 0.9 if what == "card" and places[-1] else 1
    return f"{kind}\x1f" + "".join({DIGITS: "\x100", LOWER: "\x10a", UPPER: "\x10A", "": "\x10="}.get(p, p) for p in places), size


def _permuted(key: bytes, name: str, i: int, n: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1, or its inverse: a Feistel network over two parts, walked until its value is below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def mixed(r: int, x: int, m: int) -> int:
        return int.from_bytes(hmac.digest(key, f"{name}\x1f{r}\x1f{x}".encode(), "sha512"), "big") % m

    while True:
        x, y = i % a, i // a
        for r in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if r % 2:
                y = (y + sign * mixed(r, x, b)) % b
            else:
                x = (x + sign * mixed(r, y, a)) % a
        i = x + a * y
        if i < n:
            return i


def shifted(key: bytes, kind: str, value: str) -> str:
    """The value that follows in one keyed cycle through all values of the space: other values have others, and none but the only one of a space stays as it is. It may be a value that the corpus holds."""
    what, name = kind.partition(" ")[0], space(kind, value)[0]
    if what == "ip":
        _, fixed, _ = _address_class(value)
        octets = list(map(int, value.split(".")))
        places, digits = [256] * (4 - fixed), octets[fixed:]
    else:
        chars = _places(what, value)
        at = [k for k, p in enumerate(chars) if len(p) > 1]
        places, digits = [len(chars[k]) for k in at], [chars[k].index(value[k]) for k in at]
    n, i = math.prod(places), 0
    if n < 2:
        return value
    for p, d in zip(places, digits, strict=True):
        i = i * p + d
    while True:
        i = _permuted(key, name, (_permuted(key, name, i, n, back=True) + 1) % n, n)
        rest, new = i, []
        for p in reversed(places):
            rest, d = divmod(rest, p)
            new.insert(0, d)
        if what == "ip":
            out = ".".join(map(str, octets[:fixed] + new))
            if _address_class(out)[0] == _address_class(value)[0]:
                return out
            continue
        made = list(value)
        for k, d in zip(at, new, strict=True):
            made[k] = chars[k][d]
        out = "".join(made)
        if what == "card" and chars[-1] and _luhn(out) == 0:
            continue  # numbers that fail the check stay apart from those that pass
        return next(out[:-1] + d for d in DIGITS if _luhn(out[:-1] + d) == 0) if chars[-1] == "" else out


def surrogate(key: bytes, kind: str, value: str, gender: str = "", attempt: int = 0) -> str:
    """The canonical value that stands for another of the same kind: same length and classes of characters, valid where the first is. A number keeps its calling code, an address its class, a domain its ending, a given name its gender; later attempts draw from more. An attempt below 0 stands for shifted()."""
    if attempt < 0:
        return shifted(key, kind, value)
    s = _stream(key, kind, value, attempt)
    draw = lambda n: (next(s) << 16 | next(s) << 8 | next(s)) % n
    kind, _, more = kind.partition(" ")
    if kind == "given" and not attempt:
        return GIVEN[more, gender][draw(len(GIVEN[more, gender]))].lower()
    if kind in ("given", "family"):
        stem = "".join(FAMILY[more][draw(len(FAMILY[more]))] for _ in range((3 if kind == "family" else 2) + attempt // 4))
        return stem + (ENDINGS[more][gender] if kind == "given" else "")
    if kind == "ip":
        return _address(value, draw)
    head = (_code(value) or (attempt < 10)) if kind == "phone" else int(attempt < 10) if kind == "card" else 4 if value.startswith("AKIA") else 0
    tail = len(value) - value.rfind(".") if kind == "domain" else 0
    out = list(value[:head])
    for c in value[head : len(value) - tail]:
        if c.isdigit():
            out.append(str(draw(10)))
        elif c.isascii() and c.isalpha():
            letters = "abcdef" if kind == "secret" and re.fullmatch("[0-9a-f]+", value) else "abcdefghijklmnopqrstuvwxyz"
            x = letters[draw(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    out = "".join(out) + value[len(value) - tail :]
    if kind == "card" and (_luhn(value) == 0) != (_luhn(out) == 0):
        out = next(x for d in range(10) if (_luhn(x := out[:-1] + str((int(out[-1]) + d) % 10)) == 0) == (_luhn(value) == 0))
    return out


def in_format(kind: str, found: str, values: list[str]) -> str:
    """Canonical surrogates of an entity's units in the shape of the text that they replace: its separators, its case."""
    if kind in ("card", "phone"):
        d = iter(values[0].lstrip("+"))
        return "".join(next(d) if c.isdigit() else c for c in found)
    if kind == "name":
        new = iter(values)
        cased = lambda o: o if len(o) < 2 else next(new).upper() if o.isupper() else next(new).capitalize()
        return "".join(x if x in " -'’" else cased(x) for x in re.split("([ '’-])", found) if x)
    if kind == "email":
        return "".join(v.upper() if f.isupper() else v for f, v in zip(found, "@".join(values), strict=True))
    return values[0]


def entities(docs: DataFrame, id_col: str = "_tid", text_col: str = "_text") -> DataFrame:
    """id_col, kind, value, gender: each unit of each text, once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for b in by_bytes(batches, "_t"):
            rows = [(i, *u) for i, t in zip(b.column("_i").to_pylist(), b.column("_t").to_pylist(), strict=True) if t for u in {u for x in find(t) for u in x[3]}]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *map(pa.array, cols[1:])], ["_i", "kind", "value", "gender"])

    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInArrow(tidy(run), "_i binary, kind string, value string, gender string").withColumnRenamed("_i", id_col)


def draw_again(found: DataFrame, key: bytes, fullest: float = 0.125) -> DataFrame:
    """kind, value, gender, attempt of the units of found(kind, value, gender) whose first surrogate won't do, or whose gender isn't the same at all mentions.

    A surrogate must not stand for two units, nor be one that the corpus holds.
    Of several units with one surrogate the first in order keeps it; the others
    draw again, and are held against all that is settled, until none is left. Only
    the losers of a round enter the next. A given name that has one gender where its
    titles tell has it everywhere.

    A space of values (see space()) of which the corpus holds more than `fullest` isn't
    drawn from: its values take each other's place by a keyed cycle (attempt -1), which
    keeps them distinct however many there are. In all other spaces a draw succeeds
    three times in four, so that the rounds end.
    """
    told = F.collect_set(F.when(~F.col("gender").isin("", "n"), F.col("gender")))
    real = found.groupBy("kind", "value").agg(told.alias("told"), F.max(F.col("gender") != "").alias("has"), F.min("gender").alias("lo"), F.max("gender").alias("hi"))
    real = real.withColumn("gender", F.when(F.size("told") == 1, F.get("told", F.lit(0))).when(F.col("has"), "n").otherwise(""))
    real = written(real.select("kind", "value", "gender", (F.col("lo") != F.col("hi")).alias("mixed")), "entities")
    family = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("family")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [surrogate(key, k, v, g, n) for k, v, g, n in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "gender", "attempt")), strict=True)]
            yield b.append_column("other", pa.array(out, pa.string()))


    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes = zip(*[space(k, v) for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist(), strict=True)], strict=True) if b.num_rows else ((), ())
            yield b.append_column("space", pa.array(names, pa.string())).append_column("room", pa.array(sizes, pa.float64()))

    placed = written(real.mapInArrow(tidy(spaces), "kind string, value string, gender string, mixed boolean, space string, room double"), "spaces")
    full = placed.where("space <> ''").groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.min("room").alias("room")).where(F.col("n") > F.col("room") * fullest)
    full = written(full.select("space"), "full")
    swapped = placed.join(full, "space", "left_semi").select("kind", "value", "gender", F.lit(-1).alias("attempt"))
    left = placed.join(full, "space", "left_anti").select("kind", "value", "gender", "mixed", F.lit(0).alias("attempt"))
    settled, taken, again = None, real.select(family, F.col("value").alias("other")).distinct(), swapped
    for _ in count():
        drawn = left.mapInArrow(tidy(draw), "kind string, value string, gender string, mixed boolean, attempt int, other string").withColumn("family", family)
        place = F.row_number().over(Window.partitionBy("family", "other").orderBy("value", "kind"))
        drawn = written(drawn.withColumn("place", place), "drawn")
        good = drawn.where("place = 1").join(taken, ["family", "other"], "left_anti")
        if settled is not None:
            good = good.join(settled, ["family", "other"], "left_anti")
        good = written(good.select("family", "other", "kind", "value", "gender", "mixed", "attempt"), "good")
        later = good.where("attempt > 0 or mixed").select("kind", "value", "gender", "attempt")
        again = again.unionByName(later)
        settled = good.select("family", "other") if settled is None else settled.unionByName(good.select("family", "other"))
        left = drawn.join(good, ["kind", "value"], "left_anti").select("kind", "value", "gender", "mixed", (F.col("attempt") + 1).alias("attempt"))
        left = written(left, "left")
        if not left.limit(1).count():
            return written(again, "again")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_sent: int = 50_000) -> DataFrame:
    """Every row of docs with its text's entities replaced; n_entities and n_swapped added, the latter counts entities whose surrogate may be another's real value (see draw_again).

    The same entity gets the same surrogate everywhere (e-mail addresses and names
    without regard to case, numbers without regard to separators), and different ones
    get different ones: units of entities do (see Finder). A surrogate is a keyed
    function of the unit, so that texts need no join; the few units that had to draw
    again are sent to all tasks if they are at most most_sent, and else joined to the
    documents that hold them.

    Null texts stay null with 0 entities; ids may be null or repeat; other columns
    pass through, but an earlier n_entities or n_swapped, which is replaced. A value of
    which there is no other of its form, such as a local part of signs only, stays.
    """
    docs = docs.drop("n_entities", "n_swapped")
    rows = docs.select(text_hash(F.col(text_col)).alias("_tid"), F.col(text_col).alias("_text"))
    found = entities(rows)
    again = draw_again(found.select("kind", "value", "gender"), key)
    n = again.count()
    few = {(r.kind, r.value): (r.gender, r.attempt) for r in again.collect()} if n <= most_sent else None

    def change(text: str | None, own: dict, find: Finder, known: dict) -> tuple[str | None, int, int]:
        spans = find(text) if text else []
        if not spans:
            return text, 0, 0
        out, at, swapped = [], 0, 0
        for a, b, kind, units in spans:
            new = []
            for k, v, g in units:
                unit = (k, v, *own.get((k, v), (g, 0)))
                if unit not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[unit] = surrogate(key, *unit)
                new.append(known[unit])
            swapped += any(own.get(u[:2], (u[2], 0))[1] < 0 for u in units)
            out += [text[at:a], in_format(kind, text[a:b], new)]
            at = b
        return "".join(out) + text[at:], len(spans), swapped

    names = docs.columns
    extra, tid = fresh(docs, "again"), fresh(docs, "tid")
    if few is None:
        once = found.dropDuplicates(["_tid", "kind", "value"])  # equal texts have one _tid: once per text, not per row
        held = once.drop("gender").join(again, ["kind", "value"]).groupBy("_tid").agg(F.collect_list(F.struct("kind", "value", "gender", "attempt")).alias(extra))
        docs = docs.withColumn(tid, text_hash(F.col(text_col))).join(written(held.withColumnRenamed("_tid", tid), "held"), tid, "left").drop(tid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = Finder(), {}
        for b in by_bytes(batches, text_col):
            texts = b.column(text_col).to_pylist()
            own = [few] * len(texts) if few is not None else [{(x["kind"], x["value"]): (x["gender"], x["attempt"]) for x in xs or ()} for xs in b.column(extra).to_pylist()]
            new = [change(t, o, find, known) for t, o in zip(texts, own, strict=True)]
            cols = [pa.array([x[0] for x in new], pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([x[i] for x in new], pa.int32()) for i in (1, 2)]], [*names, "n_entities", "n_swapped"])

    schema = docs.select(names).schema.add("n_entities", IntegerType()).add("n_swapped", IntegerType())
    return docs.mapInArrow(tidy(run), schema)
