"""128-bit time-ordered ids in their 26-character text form, which sorts as the bytes do."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of Crockford's base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode(value: int) -> str:
    return "".join(ALPHABET[value >> shift & 31] for shift in range(125, -1, -5))


def new(ms: int | None = None, entropy: bytes | None = None) -> str:
    ms = int(time.time() * 1000) if ms is None else ms
    return encode(ms << 80 | int.from_bytes(entropy or os.urandom(10), "big"))


def parse(text: str) -> int:
    """The number; ValueError where the text is no id."""
    if len(text) != 26 or text[0] > "7":
        raise ValueError(f"not an id: {text!r}")
    value = 0
    for c in text.upper():
        value = value << 5 | ALPHABET.index(c)
    return value


def timestamp_ms(text: str) -> int:
    return parse(text) >> 80


def timed(ms: Column, seed: Column) -> Column:
    """An id column of a time, with the other 80 bits from a hash of `seed`."""
    letter = lambda value: F.substring(F.lit(ALPHABET), (value.bitwiseAND(31) + 1).cast("int"), F.lit(1))
    head = F.transform(F.sequence(F.lit(45), F.lit(0), F.lit(-5)), lambda shift: letter(F.call_function("shiftright", ms, shift)))
    rest = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: letter(F.xxhash64(seed, i)))
    return F.array_join(F.concat(head, rest), "")


def created_ms(ids: Column) -> Column:
    """Milliseconds since 1970 of an id column, from its first ten characters."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.position(F.substring(ids, i, F.lit(1)), F.lit(ALPHABET)) - 1)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda total, d: total * 32 + d)
