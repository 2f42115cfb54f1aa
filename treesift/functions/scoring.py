"""How well a name matches a term.  Positions and lengths are in UTF-8 bytes.

Scores of exact, whole-word and pattern matches are expressions; those of fuzzy matches need dynamic
programming over bytes and are an Arrow UDF, which a query attaches only to rows that have matched and
which aligns whole batches at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..sources.keep import ship

# The weights of the scores.
BASE, FAR = 1000, 900
START, BOUNDARY, WORD_START = 150, 60, 80
TIGHT = 40
PATTERN_BASE = 700
GREEDY_CHAR, GREEDY_NEXT, GREEDY_BOUNDARY = 16, 12, 18
ALIGN_CHAR, ALIGN_BOUNDARY, ALIGN_NEXT, GAP_OPEN, GAP_MORE = 16, 10, 4, 3, 1
ALIGN_NEEDLE, ALIGN_HAY = (3, 32), 255
SEPARATORS = "/_-. "
PROBES = 4
CAMEL_BYTES = 64
DEPTH_CAP = 16
SCORE_CAP = (2**31 - 1) // 64 - 16
HOUR_NS = 3600 * 10**9
FUZZY_ROWS = 2048  # texts that are aligned together
RECENT = ((HOUR_NS, 60), (24 * HOUR_NS, 40), (7 * 24 * HOUR_NS, 20))


def byte_before(hay: Column, at: Column) -> Column:
    """Bytes before the character at a 1-based place."""
    return F.octet_length(F.substring(hay, F.lit(1), at - 1))


def tightness(hay: Column, needle: str) -> Column:
    return F.greatest(F.lit(0), F.lit(TIGHT) - (F.octet_length(hay) - F.lit(len(needle.encode()))))


def _boundary(hay: Column, cased: Column | None, at: Column) -> Column:
    """Whether a word begins at a place: after a separator or, with the cased name, at a hump."""
    before = F.substring(hay, at - 1, F.lit(1))
    out = before.isin(*SEPARATORS)
    if cased is not None:
        hump = F.substring(cased, at - 1, F.lit(2)).rlike("^[a-z0-9][A-Z]$")
        out = out | (hump & (byte_before(hay, at) < CAMEL_BYTES))
    return out


def exact_score(hay: Column, needle: str, cased: Column | None) -> Column:
    """Of the first occurrence; if that is inside a word, a later one at a boundary may score more."""
    n = F.lit(needle)

    def score(at: Column, bonus: int) -> Column:
        return F.lit(BASE + bonus) - F.least(byte_before(hay, at), F.lit(FAR))

    first = F.locate(needle, hay)

    def probe(seen: Column, _: Column) -> Column:
        at = F.when(seen["at"] > 0, _locate_from(n, hay, seen["at"] + 1)).otherwise(0)
        hit = seen["found"].isNull() & (at > 0) & _boundary(hay, cased, at)
        return F.struct(at.alias("at"), F.when(hit, score(at, BOUNDARY)).otherwise(seen["found"]).alias("found"))

    # a loop, and not one expression for each probe, which would make more code than is compiled
    start = F.struct(first.alias("at"), F.lit(None).cast("int").alias("found"))
    later = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), start, probe, lambda seen: seen["found"])
    inner = F.greatest(score(first, 0), later)
    best = F.when(first == 1, score(first, START)).when(_boundary(hay, cased, first), score(first, BOUNDARY)).otherwise(inner)
    return best + tightness(hay, needle)


def _locate_from(needle: Column, hay: Column, at: Column) -> Column:
    return F.call_function("locate", needle, hay, at)


def whole_word_score(hay: Column, at: Column) -> Column:
    start = (at == 1) | F.substring(hay, at - 1, F.lit(1)).isin(*SEPARATORS)
    return F.lit(BASE) - F.least(byte_before(hay, at), F.lit(FAR)) + F.when(start, WORD_START).otherwise(0)


def pattern_score(hay: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(PATTERN_BASE) - F.octet_length(hay))


def camel_humps(name: bytes) -> int:
    """Bit i: byte i is an upper-case letter after a lower-case one or a digit."""
    out = 0
    for i in range(1, min(len(name), CAMEL_BYTES)):
        before = name[i - 1 : i]
        if name[i : i + 1].isupper() and (before.islower() or before.isdigit()):
            out |= 1 << i
    return out


def _boundaries(hay: bytes, humps: int) -> list[bool]:
    return [i == 0 or chr(hay[i - 1]) in SEPARATORS or bool(i < CAMEL_BYTES and humps >> i & 1) for i in range(len(hay))]


def greedy_fuzzy(hay: bytes, needle: bytes, humps: int = 0) -> tuple[int, int] | None:
    """(score, first place) of the left-most embedding of the needle's bytes; None if there is none."""
    edge, total, last, first = _boundaries(hay, humps), 0, None, 0
    at = 0
    for byte in needle:
        at = hay.find(byte, at)
        if at < 0:
            return None
        if last is None:
            first = at
        total += GREEDY_CHAR + GREEDY_NEXT * (last is not None and at == last + 1) + GREEDY_BOUNDARY * edge[at]
        last, at = at, at + 1
    return max(1, total - first + max(0, TIGHT - (len(hay) - len(needle)))), first


def best_fuzzy(hay: bytes, needle: bytes, humps: int = 0) -> tuple[int, int] | None:
    """(score, start) of the best alignment with affine gaps; the greedy one out of its domain."""
    simple = greedy_fuzzy(hay, needle, humps)
    if simple is None or not ALIGN_NEEDLE[0] <= len(needle) <= ALIGN_NEEDLE[1] or len(hay) > ALIGN_HAY:
        return simple
    bonus = [ALIGN_BOUNDARY if b else 0 for b in _boundaries(hay, humps)]
    # a cell is (value, start, bonus of the run it ends); None where the byte differs
    row = [(ALIGN_CHAR + 2 * bonus[j], j, bonus[j]) if hay[j] == needle[0] else None for j in range(len(hay))]
    for byte in needle[1:]:
        new: list[tuple[int, int, int] | None] = [None] * len(hay)
        gap: tuple[int, int] | None = None  # best (value, start) after skipping at least no byte
        for j in range(1, len(hay)):
            before = row[j - 1]
            if gap is not None:
                gap = (gap[0] - GAP_MORE, gap[1])
            if before is not None and (gap is None or before[0] - GAP_OPEN > gap[0]):
                gap = (before[0] - GAP_OPEN, before[1])
            if hay[j] != byte:
                continue
            if gap is not None:
                new[j] = (gap[0] + ALIGN_CHAR + bonus[j], gap[1], bonus[j])
            if before is not None:
                value = before[0] + ALIGN_CHAR + max(bonus[j], before[2], ALIGN_NEXT)
                if new[j] is None or value >= new[j][0]:
                    new[j] = (value, before[1], max(before[2], bonus[j]))
        row = new
    best = max((cell for cell in row if cell is not None), key=lambda c: c[0] - c[1], default=None)
    if best is None:
        return simple
    return max(1, best[0] - best[1] + max(0, TIGHT - (len(hay) - len(needle)))), best[1]


def fuzzy_scores(hays: list[bytes | None], cased: list[bytes | None], needle: bytes) -> list[int | None]:
    """The scores of `best_fuzzy` for many texts at once: every step of the alignment is done for all of them."""
    out: list[int | None] = [None] * len(hays)
    aligned = []
    for i, hay in enumerate(hays):
        if hay is None:
            continue
        if ALIGN_NEEDLE[0] <= len(needle) <= ALIGN_NEEDLE[1] and len(hay) <= ALIGN_HAY:
            aligned.append(i)
        else:
            found = greedy_fuzzy(hay, needle, camel_humps(cased[i] or b""))
            out[i] = None if found is None else found[0]
    if not aligned:
        return out
    size = np.array([len(hays[i]) for i in aligned])
    width = max(1, int(size.max()))
    text = _columns([hays[i] for i in aligned], width)
    shown = _columns([cased[i] or b"" for i in aligned], width)
    after = np.zeros(text.shape, dtype=bool)  # a word begins here
    after[0] = True
    after[1:] = np.isin(text[:-1], np.frombuffer(SEPARATORS.encode(), np.uint8))
    n = min(width, CAMEL_BYTES)
    after[1:n] |= _among(shown[1:n], "AZ") & (_among(shown[: n - 1], "az") | _among(shown[: n - 1], "09"))
    bonus = np.where(after, ALIGN_BOUNDARY, 0).astype(np.int32)
    inside = np.arange(width)[:, None] < size
    nothing = np.int32(-(1 << 28))

    # by place and text: the value of the cell there, where its alignment starts, the bonus of the run it ends
    here = (text == needle[0]) & inside
    value, start, run = np.where(here, ALIGN_CHAR + 2 * bonus, nothing), np.where(here, np.arange(width, dtype=np.int32)[:, None], 0), bonus
    for byte in needle[1:]:
        here = (text == byte) & inside
        new, begun, carried = np.full_like(value, nothing), np.zeros_like(start), np.zeros_like(run)
        gap, gap_start = np.full(len(size), nothing), np.zeros(len(size), np.int32)
        for j in range(1, width):
            before = value[j - 1]
            gap -= GAP_MORE
            opened = before - GAP_OPEN > gap
            gap[opened], gap_start[opened] = before[opened] - GAP_OPEN, start[j - 1][opened]
            if not here[j].any():
                continue
            far = gap + ALIGN_CHAR + bonus[j]
            near = before + ALIGN_CHAR + np.maximum(np.maximum(bonus[j], run[j - 1]), ALIGN_NEXT)
            close = near >= far
            new[j] = np.where(here[j], np.where(close, near, far), nothing)
            begun[j] = np.where(close, start[j - 1], gap_start)
            carried[j] = np.where(close, np.maximum(run[j - 1], bonus[j]), bonus[j])
        value, start, run = new, begun, carried
    best = np.where(value > nothing // 2, value - start, nothing).max(axis=0)
    score = np.maximum(1, best + np.maximum(0, TIGHT - (size - len(needle))))
    for i, s, b in zip(aligned, score.tolist(), best.tolist()):
        if b > nothing // 2:
            out[i] = s
    return out


def _columns(texts: list[bytes], width: int) -> np.ndarray:
    """The bytes of texts by place and text, zero after the end."""
    out = np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), np.uint8)
    return np.ascontiguousarray(out.reshape(-1, width).T)


def _among(x: np.ndarray, ends: str) -> np.ndarray:
    return (x >= ord(ends[0])) & (x <= ord(ends[1]))


def fuzzy_score(needle: str) -> Callable[[Column, Column], Column]:
    """A UDF of (folded text, cased text or null) with the score of the best alignment, null without one."""
    ship()
    wanted = needle.encode()

    @F.pandas_udf("int")
    def score(hay: pd.Series, cased: pd.Series) -> pd.Series:
        hays, shown = ([None if pd.isna(x) else x.encode() for x in column] for column in (hay, cased))
        out: list[int | None] = []
        for k in range(0, len(hays), FUZZY_ROWS):
            out += fuzzy_scores(hays[k : k + FUZZY_ROWS], shown[k : k + FUZZY_ROWS], wanted)
        return pd.Series(out, dtype="Int32")

    return score


def recency(mtime_ns: Column, now: float) -> Column:
    """A bonus for what was modified within an hour, a day or a week; none without a clock."""
    if now <= 0:
        return F.lit(0)
    age = F.lit(int(now * 1e9)) - mtime_ns
    out = F.lit(0)
    for span, bonus in reversed(RECENT):
        out = F.when(age <= span, bonus).otherwise(out)
    return out


def frecency(count: Column, last_run: Column, now: float, half_life_days: float = 14) -> Column:
    """Opens, halved with every half-life since the last."""
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - last_run)
    return F.when(count > 0, count * F.pow(F.lit(2.0), -age / (half_life_days * 86_400))).otherwise(0.0)


def frecency_boost(score: Column) -> Column:
    return F.coalesce((F.lit(30.0) * F.log2(F.lit(1.0) + score)).cast("int"), F.lit(0))


def final_score(score: Column, depth: Column) -> Column:
    """The match score, with less depth before more where it is equal."""
    return F.least(score, F.lit(SCORE_CAP)) * 64 - F.least(depth, F.lit(DEPTH_CAP))
