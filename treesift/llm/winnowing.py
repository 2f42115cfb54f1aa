"""Benchmark decontamination by winnowing.

Words are runs of `[0-9a-z]` and everything beyond ASCII, of the text with A-Z lower-cased.  A window
is `WINDOW` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window.  A word of a document is hit if it lies in any occurrence of a window.

Both sides keep the minimum hash of the `GRAM`-word runs in every sliding window of
WINDOW - GRAM + 1 runs (the rightmost of equal ones), so any shared span of `WINDOW` words has a
fingerprint in common, at the same place of the span: none is missed.  The fingerprints (hash, item,
position) of the benchmark are joined with those of a document, and each common one is extended word by
word to both sides; where that gives `WINDOW` words or more, the spans are compared as text, so that a
hash collision adds nothing.  Items shorter than WINDOW have no sliding window; all runs of their exact
length are looked up and compared instead.

The benchmark is read in blocks of at most `block_bytes` of text, each broadcast for one pass over
the documents; there is one block, and so one pass, unless the benchmark is larger than that.  A block
takes its text once more, 12 bytes for each word and about 5 for fingerprints: some 4 times its text
while it is built, and 3 times in each worker.

Defined results: a null text has no words; a document without words has no hits; an item without
words (or null) has no window; items with the same id count once, and so do all without an id, which
hit like others but are not named.  Repeated documents are judged row by row.  Extra columns are not
read (`scan`) or handed on (`clean`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import cut, ship
from ._text import ALNUM_LOWER, CHUNK_BYTES, Words, chunks, fits, grams, pieces, same_spans, steps, utf8

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_PAIRS = 1 << 18


def winnow(gram: np.ndarray, runs: int) -> np.ndarray:
    """For each sliding window of `runs` hashes the position of its minimum, the rightmost of equal ones."""
    n = max(0, len(gram) - runs + 1)
    least, at = gram[:n].copy(), np.arange(n)
    for j in range(1, runs):
        other = gram[j : j + n]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + j
    return at


class Index:
    """The words of a block of items, as text and as hashes, and the places of their fingerprints.

    Items of the same words are one.  `body` holds all words with one space after each; word i begins at
    start[i], item k has words first[k]:first[k + 1] and the ids names[k].  By number of words of a run
    (`GRAM` for fingerprints, the whole length for shorter items) `places` has sorted hashes and the
    words where the runs begin.
    """

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names: list[set[str | None]] = []
        known: dict[bytes, int] = {}
        body, size, hashes, first = [], [], [], [0]
        found: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        base = 0
        for names, texts in _portions(items):
            words = Words(*utf8(pa.array(texts, pa.large_string())), ALNUM_LOWER)
            joined, start, end = words.joined()
            new = np.zeros(len(texts), dtype=bool)
            for d, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                if lo == hi:
                    continue
                text = joined[start[lo] : end[hi - 1] + 1]
                key = blake2b(text, digest_size=16).digest()
                if key not in known:
                    known[key], new[d] = len(self.names), True
                    self.names.append(set())
                    body.append(np.frombuffer(text, np.uint8))
                    first.append(first[-1] + hi - lo)
                self.names[known[key]].add(names[d])
            # the words of new items alone, with their places among all words
            count = words.counts * new
            own = np.repeat(words.first[:-1], count) + steps(count)
            place = base + np.arange(len(own))
            hashed = words.hashes()
            size.append((end - start)[own] + 1)
            hashes.append(hashed[own])
            marks = winnow(grams(hashed, gram), window - gram + 1)
            full = fits(words, window)
            chosen = np.zeros(len(words), dtype=bool)
            chosen[marks[np.flatnonzero(full[: len(marks)])]] = True
            picked = np.flatnonzero(chosen[own])
            found.setdefault((gram, True), []).append((grams(hashed, gram)[own[picked]], place[picked]))
            begins = np.cumsum(count) - count
            for n in np.unique(count[(count > 0) & (count < window)]).tolist():
                picked = begins[count == n]
                found.setdefault((n, False), []).append((grams(hashed, n)[own[picked]], place[picked]))
            base += len(own)
        self.body = np.concatenate(body) if body else np.zeros(0, np.uint8)
        self.start = np.zeros(base + 1, np.int64)
        np.cumsum(np.concatenate(size) if size else [], out=self.start[1:])
        if len(self.body) < 1 << 31:
            self.start = self.start.astype(np.int32)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.array(first, np.int64)
        self.places: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in list(found):
            known_hash, place = (np.concatenate(x) for x in zip(*found.pop(kind)))
            if len(place):
                order = np.argsort(known_hash, kind="stable")
                self.places[kind] = known_hash[order], place[order].astype(self.start.dtype), _filter(known_hash)

    def _pairs(self, kind: tuple[int, bool], at: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word of the chunk, word of the block) where runs of the same hash begin, some at a time."""
        known, place, quick = self.places[kind]
        near = _among(hashed, known, quick)
        at, hashed = at[near], hashed[near]
        lo = np.searchsorted(known, hashed)
        n = np.searchsorted(known, hashed, side="right") - lo
        for i, j in pieces(n, _PAIRS):
            yield np.repeat(at[i:j], n[i:j]), place[np.repeat(lo[i:j], n[i:j]) + steps(n[i:j])].astype(np.int64)

    def _extended(self, words: Words, hashed: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the chunk, of the block, length) of the spans of `window` words or more around common fingerprints."""
        text, item = np.searchsorted(words.first, a, side="right") - 1, np.searchsorted(self.first, b, side="right") - 1
        before = np.minimum(a - words.first[text], b - self.first[item])
        after = np.minimum(words.first[text + 1] - a, self.first[item + 1] - b)
        same = np.ones(len(a), dtype=bool)
        for j in range(self.gram):
            same &= hashed[a + j] == self.hash[b + j]
        left, right = np.zeros(len(a), np.int64), np.full(len(a), self.gram)
        for side, room, sign in ((left, before, -1), (right, after - 1, 1)):
            going = np.flatnonzero(same)
            for j in range(1, self.window - self.gram + 1):
                step = j if sign < 0 else self.gram - 1 + j
                going = going[room[going] >= step]
                going = going[hashed[a[going] + sign * step] == self.hash[b[going] + sign * step]]
                side[going] += 1
        long = same & (left + right >= self.window)
        a, b, size = (a - left)[long], (b - left)[long], (left + right)[long]
        # spans that overlap on the same diagonal are parts of one
        order = np.lexsort((a, a - b))
        a, b, size = a[order], b[order], size[order]
        if not len(a):
            return a, b, size
        apart = np.append(True, ((a - b)[1:] != (a - b)[:-1]) | (a[1:] >= (a + size)[:-1]))
        head = np.flatnonzero(apart)
        return a[head], b[head], np.maximum.reduceat(a + size, head) - a[head]

    def _same(self, joined: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which spans of words have the same text."""
        length = end[a + size - 1] - start[a]
        out = length == self.start[b + size].astype(np.int64) - 1 - self.start[b]
        fit = np.flatnonzero(out)
        out[fit] = same_spans(joined, start[a[fit]], self.body, self.start[b[fit]].astype(np.int64), length[fit])
        return out

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first words, numbers of words, items) of the spans of a chunk that occur in items."""
        hashed = words.hashes()
        raw, start, end = words.joined()
        joined = np.frombuffer(raw, np.uint8)
        for kind in self.places:
            run, marks = kind
            gram = grams(hashed, run)
            if marks:
                chosen = np.zeros(len(words), dtype=bool)
                chosen[winnow(gram, self.window - self.gram + 1)[np.flatnonzero(fits(words, self.window))]] = True
                at = np.flatnonzero(chosen)
            else:
                at = np.flatnonzero(fits(words, run))
            for a, b in self._pairs(kind, at, gram[at]):
                size = np.full(len(a), run)
                if marks:
                    a, b, size = self._extended(words, hashed, a, b)
                same = self._same(joined, start, end, a, b, size)
                yield a[same], size[same], np.searchsorted(self.first, b[same], side="right") - 1
                if marks and not same.all():  # words of equal hashes but not equal: window by window
                    n = size[~same] - self.window + 1
                    a, b = (np.repeat(x[~same], n) + steps(n) for x in (a, b))
                    size = np.full(len(a), self.window)
                    same = self._same(joined, start, end, a, b, size)
                    yield a[same], size[same], np.searchsorted(self.first, b[same], side="right") - 1


def _portions(items: Iterable[tuple[str | None, str]]) -> Iterator[tuple[list, list[str]]]:
    """The items in lists of some megabytes of text."""
    names, texts, size = [], [], 0
    for name, text in items:
        names.append(name)
        texts.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
    if texts:
        yield names, texts


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, dtype=bool)
    out[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return out


def _among(x: np.ndarray, known: np.ndarray, quick: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted `known`; `quick` rules most of them out."""
    out = quick[x >> np.uint64(64 - _FILTER_BITS)]
    maybe = np.flatnonzero(out)
    if len(maybe):
        at = np.minimum(np.searchsorted(known, x[maybe]), len(known) - 1)
        out[maybe] = known[at] == x[maybe]
    return out


def probe(column: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, list[str | None]]]:
    """For each text: its number of words, the numbers of its hit words, and the items found (sorted, no id last)."""
    for _, _, body, at in chunks(column):
        words = Words(body, at, ALNUM_LOWER)
        step = np.zeros(len(words) + 1, np.int64)
        found: dict[int, set[str | None]] = {}
        for where, size, item in index.hits(words) if len(words) else ():
            np.add.at(step, where, 1)
            np.add.at(step, where + size, -1)
            text = np.searchsorted(words.first, where, side="right") - 1
            for x in np.unique(text * len(index.names) + item).tolist():
                found.setdefault(x // len(index.names), set()).update(index.names[x % len(index.names)])
        covered = np.cumsum(step[:-1]) > 0
        for d in range(len(at) - 1):
            lo, hi = words.first[d], words.first[d + 1]
            items = sorted(found[d], key=lambda i: (i is None, i)) if d in found else []
            yield int(hi - lo), (np.flatnonzero(covered[lo:hi]) if d in found else np.zeros(0, np.int64)), items


def _spans(hit: np.ndarray) -> list[dict]:
    if not len(hit):
        return []
    breaks = np.flatnonzero(np.diff(hit) > 1)
    return [{"start": int(hit[a]), "end": int(hit[b]) + 1} for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(hit) - 1))]


def _words_of(spans: list[dict]) -> np.ndarray:
    return np.concatenate([np.arange(s["start"], s["end"]) for s in spans]) if spans else np.zeros(0, np.int64)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan_batches(shared, again: bool):
    """Adds n_words, spans and items; with `again`, to what an earlier block has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = list(probe(batch.column(1), index))
            if again:
                old = batch.select(["spans", "items"]).to_pylist()
                rows = [(n, np.union1d(h, _words_of(o["spans"])), sorted({*i, *o["items"]}, key=lambda x: (x is None, x))) for (n, h, i), o in zip(rows, old)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([_spans(h) for _, h, _ in rows], _SPANS), pa.array([i for _, _, i in rows], pa.list_(pa.string()))],
                names=["id", "text", "n_words", "spans", "items"],
            )

    return run


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """Indexes of the benchmark, each of about `block_bytes` of text."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Index((r.item, r.text) for r in part.toLocalIterator())


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans, items): for each document its hit spans, in words, and the items found."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(out.dtypes)['id']}, text string, {_RESULT}"
    for k, index in enumerate(_blocks(bench, item_col, item_text, block_bytes)):
        shared = spark.sparkContext.broadcast(index)
        out = (cut(out) if k else out).mapInArrow(_scan_batches(shared, k > 0), schema)
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """One row of counts for each row of `scan`."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _clean_batches(shared, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not len(hit) for _, hit, _ in probe(batch.column(position), index)], pa.bool_()))

    return run


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    position = docs.columns.index(text_col)
    for index in _blocks(bench, item_col, item_text, block_bytes):
        docs = docs.mapInArrow(_clean_batches(spark.sparkContext.broadcast(index), position), docs.schema)
    return docs
