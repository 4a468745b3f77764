"""Keyed identifiers in columns: persons, records, quasi-identifiers and whole rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from siglot.operators.parsing import cell, hmac_token, normalize

LEAST_KEY = 32  # bytes
TEST_KEY = hashlib.sha256(b"siglot public test key").digest()
SEPARATOR = "\x1f"


class Pseudonyms:
    """HMAC-SHA256 identifiers under one secret key; real data are refused under the public test key, and any key that is too short is refused.

    The key stands in the plan as a literal: whoever reads plans can read it.
    """

    def __init__(self, key: bytes, size: int = 20, test_data: bool = False):
        if len(key) < LEAST_KEY:
            raise ValueError(f"the key has {len(key)} bytes, {LEAST_KEY} are needed")
        if key == TEST_KEY and not test_data:
            raise ValueError("the public test key is for test data only")
        self.key, self.size = key, size

    def token(self, namespace: str, *parts: Column) -> Column:
        """The first `size` hex digits over the namespace and the parts as normalize() leaves them; an unknown part counts as empty."""
        return hmac_token(F.concat_ws(SEPARATOR, F.lit(namespace), *[F.coalesce(normalize(p.cast("string")), F.lit("")) for p in parts]), self.key, self.size)

    def person(self, name: Column, birth: Column, sex: Column, source: Column, row: Column) -> tuple[Column, Column]:
        """(person_id, strength): strong ids link the reports of a person. Without name or birth date they could merge different people, so weak ids belong to one row of one source."""
        strong = (F.coalesce(normalize(name.cast("string")), F.lit("")) != "") & birth.isNotNull()
        person = F.when(strong, F.concat(F.lit("P"), self.token("person", name, birth, sex))).otherwise(F.concat(F.lit("W"), self.token("weak", source, row)))
        return person, F.when(strong, "strong").otherwise("weak")

    def record(self, source: Column, row: Column) -> Column:
        return F.concat(F.lit("R"), self.token("record", source, row))

    def generic(self, namespace: str, value: Column) -> Column:
        return F.concat(F.lit(namespace[:1].upper()), F.substring(self.token(namespace, value), 1, 12))

    def row_digest(self, *cells: Column) -> Column:
        """24 hex digits over all cells of a row, for finding exact copies without keeping values."""
        return hmac_token(F.concat_ws(SEPARATOR, *[F.coalesce(cell(c), F.lit("")) for c in cells]), self.key, 24)
