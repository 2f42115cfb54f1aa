"""Which characters of a name a query has matched."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from ..plans.query import EXACT, FUZZY
from ..sources.keep import ship

SPANS = "array<struct<start:int,length:int>>"


def _terms(query: str, mode: str) -> list[str]:
    words = (query.replace('"', "") if mode == EXACT else query).split(" ")
    special = "*?" if mode == EXACT else ""
    return [w for w in words if w and ":" not in w and w[0] not in "-!" and not any(c in w for c in special)]


def spans(name: str, query: str, mode: str = EXACT) -> list[tuple[int, int]]:
    """(first character, number of characters) of every part to highlight."""
    out: set[tuple[int, int]] = set()
    low = [c.lower() for c in name]
    for term in _terms(query.strip(), mode):
        if mode == EXACT:
            out.update(_occurrences(low, term))
        elif mode == FUZZY:
            wanted, at = list(term.lower()), 0
            for i, c in enumerate(low):
                if at < len(wanted) and c[:1] == wanted[at]:
                    out.add((i, 1))
                    at += 1
    return sorted(out)


def _occurrences(low: list[str], term: str) -> Iterator[tuple[int, int]]:
    wanted, at = [c.lower() for c in term], 0
    while at + len(wanted) <= len(low):
        if low[at : at + len(wanted)] == wanted:
            yield at, len(wanted)
            at += len(wanted)
        else:
            at += 1


def highlight(name: Column, query: str, mode: str = EXACT) -> Column:
    """The spans of each name as an array; none for pattern and regular-expression queries."""
    ship()

    @F.pandas_udf(SPANS)
    def find(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [] if n is None else [{"start": a, "length": b} for a, b in spans(n, query, mode)])

    return find(name)
