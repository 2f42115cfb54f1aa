"""Operands of filters: integers, sizes and dates.  A text that is none gives None."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

INT64_MAX, INT64_MIN = (1 << 63) - 1, -(1 << 63)
_UNITS = {"k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "b": 1, "": 1}
_SIZE = re.compile(r"(>=|<=|>|<)?\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*([kmg]?b?)", re.I | re.A)
_LENGTH = re.compile(r"(>=|<=|>|<|=)?\s*([+-]?\d+)", re.A)
_RANGE = re.compile(r"([+-]?\d+)\.\.([+-]?\d+)", re.A)
_DATE = re.compile(r"([<>]?)(\d{1,4})-(\d{1,2})-(\d{1,2})", re.A)
_DAY = 86_400

Comparison = tuple[str, int]


def clamp(x: float) -> int:
    """The nearest 64-bit integer; halves go away from zero."""
    if x >= 2.0**63:
        return INT64_MAX
    if x <= -(2.0**63):
        return INT64_MIN
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def length_filter(text: str) -> list[Comparison] | None:
    """`5`, `=5`, `>20`, `<=8`, and the inclusive range `3..8`."""
    text = text.strip()
    if m := _RANGE.fullmatch(text):
        return [(">=", int(m[1])), ("<=", int(m[2]))]
    if m := _LENGTH.fullmatch(text):
        return [(m[1] or "=", int(m[2]))]
    return None


def size_filter(text: str) -> Comparison | None:
    """`>1kb`, `<=1.5m`, `10`: powers of 1024, rounded, held within 64 bits."""
    m = _SIZE.fullmatch(text.strip())
    if m is None:
        return None
    try:
        size = float(m[2]) * _UNITS[m[3].lower()]
    except OverflowError:
        return None
    return (m[1] or "=", clamp(size)) if math.isfinite(size) else None


def date_filter(text: str, now: float, zone: str = "UTC") -> tuple[int | None, int | None] | None:
    """Half-open bounds in nanoseconds of a day, a relative window, or what is before or after a day."""
    tz = ZoneInfo(zone)
    text = text.lower()
    today = datetime.fromtimestamp(now, tz).replace(hour=0, minute=0, second=0, microsecond=0).timestamp()
    windows = {"today": (0, 1), "yesterday": (-1, 0), "week": (-7, 1), "thisweek": (-7, 1), "month": (-30, 1)}
    if text in windows:
        first, last = windows[text]
        return clamp((today + first * _DAY) * 1e9), clamp((today + last * _DAY) * 1e9)
    m = _DATE.fullmatch(text)
    if m is None:
        return None
    try:
        day = datetime(int(m[2]), int(m[3]), int(m[4]), tzinfo=tz)
        start = (day - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(seconds=1)
    except (ValueError, OverflowError):
        return None
    if m[1] == ">":
        return clamp((start + _DAY) * 1e9), None
    if m[1] == "<":
        return None, clamp(start * 1e9)
    return clamp(start * 1e9), clamp((start + _DAY) * 1e9)
