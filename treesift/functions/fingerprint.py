"""Small fingerprints of names and paths: the characters they have, and a 64-bit hash.

The mask is a necessary condition for containment: a name without a term's bits can't hold the term.
Queries do not need it on Spark, where the containment test itself is as cheap; it is here for joins
and sketches over names.  Where no fixed hash is asked for, `xxhash64` is the faster one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from ..sources.keep import ship

# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_LETTERS, _DIGITS, _OTHERS = 26, 10, 28


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def character_bit(byte: int) -> int:
    """Letters take the first 26 bits whatever their case, digits the next ten, other bytes share the rest."""
    c = chr(byte).lower() if byte < 128 else ""
    if "a" <= c <= "z":
        return ord(c) - ord("a")
    if "0" <= c <= "9":
        return _LETTERS + ord(c) - ord("0")
    return _LETTERS + _DIGITS + byte % _OTHERS


_BITS = [1 << character_bit(b) for b in range(256)]


def character_mask(text: str) -> int:
    out = 0
    for b in set(text.encode()):
        out |= _BITS[b]
    return out


def fnv1a(text: str) -> int:
    out = FNV_OFFSET
    for b in text.encode():
        out = (out ^ b) * FNV_PRIME & (1 << 64) - 1
    return out


@F.pandas_udf(LongType())
def _mask_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _signed(character_mask(t))).astype("Int64")


@F.pandas_udf(LongType())
def _fnv_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _signed(fnv1a(t))).astype("Int64")


def mask_column(c: Column) -> Column:
    ship()
    return _mask_udf(c)


def fnv_column(c: Column) -> Column:
    ship()
    return _fnv_udf(c)


def may_contain(mask: Column, term: str) -> Column:
    """Whether a name with this mask can hold the term."""
    wanted = F.lit(_signed(character_mask(term)))
    return mask.bitwiseAND(wanted) == wanted
