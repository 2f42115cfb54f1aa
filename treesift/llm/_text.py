"""Vectorised word segmentation of UTF-8 text, shared by the operators that leave the JVM.

Texts arrive as Arrow string columns.  A batch is cut into chunks of a bounded number of bytes (one
text is never cut), and every step below works on whole chunks, so that memory is bounded by the
chunk and by the longest single text.  Bytes of 0x80 and above are parts of words under every word
rule in use, so segmenting bytes equals segmenting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but space and the ASCII controls from tab to carriage return.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of ASCII digits, ASCII lower-case letters and everything beyond ASCII.
ALNUM_LOWER = np.zeros(256, dtype=bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= CHUNK_BYTES + 1:
            _POWERS[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and its n + 1 offsets.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges with at most `limit` bytes, or one row."""
    body, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever they stand."""
    n = len(body)
    total = np.zeros(n + 1, dtype=_U64)
    np.cumsum(_BYTE_VALUE[body] * _powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INVERSE, n)[start])


_PIECE = 1 << 20


def pieces(size: np.ndarray, limit: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges (lo, hi) of entries whose sizes add up to at most `limit`, or of one entry."""
    ends, lo, done = np.cumsum(size), 0, 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def steps(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each entry, as many as its size."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of the bytes of a equal those of b."""
    out = np.zeros(len(size), dtype=bool)
    for lo, hi in pieces(size):
        n = size[lo:hi]
        step = steps(n)
        other = a[np.repeat(a_start[lo:hi], n) + step] != b[np.repeat(b_start[lo:hi], n) + step]
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n)[other], minlength=hi - lo) == 0
    return out


class Words:
    """The words of a chunk: byte positions `start` and `end`; text d has words first[d]:first[d + 1]."""

    def __init__(self, body: np.ndarray, at: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.body = LOWER[body] if lower else body
        self.at = at
        inside = is_word[self.body]
        before = np.empty(len(body) + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        before[at[:-1]] = False  # a text begins: whatever stands before belongs to another text
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(body) + 1, dtype=bool)
        after[:-1] = inside
        after[at] = False
        self.end = np.flatnonzero(np.append(False, inside) & ~after)
        self.first = np.searchsorted(self.start, at)
        self.inside = inside

    def only(self, live: np.ndarray, bytes_: np.ndarray) -> Words:
        """The words of some of the texts; `bytes_`: which bytes are theirs."""
        out = object.__new__(Words)
        size, counts = np.diff(self.at), self.counts
        out.body, out.inside = self.body[bytes_], self.inside[bytes_]
        out.at = np.append(0, np.cumsum(size[live]))
        out.first = np.append(0, np.cumsum(counts[live]))
        own = np.repeat(live, counts)
        back = np.repeat(self.at[:-1][live] - out.at[:-1], counts[live])
        out.start, out.end = self.start[own] - back, self.end[own] - back
        return out

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text within the chunk."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, the same in every chunk and process."""
        return span_hashes(self.body, self.start, self.end)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and each word's start and end in that string."""
        if not len(self.start):
            return b"", self.start, self.end
        length = self.end - self.start
        start = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1] + 1, out=start[1:])
        out = np.full(int(start[-1] + length[-1] + 1), 0x20, np.uint8)
        fill = np.ones(len(out), dtype=bool)
        fill[start + length] = False
        out[fill] = self.body[self.inside]
        return out.tobytes(), start, start + length


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (over the ends of texts too; callers leave those out)."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U64(_BASE)
        out += hashes[j : j + n]
    return mix(out)


def fits(words: Words, k: int) -> np.ndarray:
    """For each word whether k words of its text begin there."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words))
    return left >= k
