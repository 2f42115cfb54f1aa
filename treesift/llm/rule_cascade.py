"""Quality rules as a short-circuit cascade.

A rule rejects a text by statistics of its words and lines.  On a sample of the input each rule's cost
(seconds for each byte, statistics that it is the first to need included) and its selectivity (share of
texts rejected) are measured, and the rules are ordered by rejection per cost, each measured on what
those before it have passed.  Each rule then sees only the texts that all rules before it have passed,
and computes its statistics for those alone; what has been computed before is carried along.  The order
changes the work, never the verdict: a text is kept if no rule rejects it.

The sample is about `SAMPLE_ROWS` texts, whole and of any length, measured on the executors; the driver
gets a bit mask and a size for each, and the seconds of each statistic.

Words are runs of anything but space and the ASCII controls from tab to carriage return.

Defined results: null is an empty text, without words, and is rejected as too short.  Repeated rows
are judged alike.  Extra columns are not read (`judge`) or handed on (`keep`).  On an empty sample the
rules stay in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import ship
from ._text import NON_SPACE, Words, chunks, grams, mix

SAMPLE_ROWS = 1000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT = np.ones(256, dtype=bool)
_CODE_POINT[0x80:0xC0] = False  # continuation bytes
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


class Statistics:
    """Statistics of the texts of a chunk; each is computed when first asked for, and once."""

    def __init__(self, body: np.ndarray, at: np.ndarray):
        self._body, self._at, self._had = body, at, {}
        self._seconds: dict[str, float] = {}  # of each statistic, without those it needs
        self._asked: list[str] = []

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        self._asked.append(name)
        if name not in self._had:
            began, before = time.perf_counter(), sum(self._seconds.values())
            self._had[name] = getattr(self, f"_{name}")()
            self._seconds[name] = time.perf_counter() - began - (sum(self._seconds.values()) - before)
        return self._had[name]

    def only(self, live: np.ndarray) -> Statistics:
        """The statistics of some of the texts; their counts and words are carried along."""
        if live.all():
            return self
        size = np.diff(self._at)
        inside = np.repeat(live, size)
        out = Statistics(self._body[inside], np.append(0, np.cumsum(size[live])))
        for name, value in self._had.items():
            if name == "words":
                out._had[name] = value.only(live, inside)
            elif name in _COUNTED:
                out._had[name] = value[live]
        return out

    def __len__(self) -> int:
        return len(self._at) - 1

    def _words(self) -> Words:
        return Words(self._body, self._at, NON_SPACE, lower=False)

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self._at[1:]] - total[self._at[:-1]]

    def _n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        return self._per_text(self.words.inside & _CODE_POINT[self._body])

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self._body])

    def _n_digits(self) -> np.ndarray:
        return self._per_text(_DIGIT[self._body])

    def _lines(self) -> Words:
        newline = np.ones(256, dtype=bool)
        newline[0x0A] = False
        return Words(self._body, self._at, newline, lower=False)

    def _has_word(self) -> np.ndarray:
        """For each line that is not empty, whether it has a word."""
        total = np.zeros(len(self._body) + 1, np.int64)
        np.cumsum(self.words.inside, out=total[1:])
        return total[self.lines.end] > total[self.lines.start]

    def _again_line(self) -> np.ndarray:
        """For each line that has a word, whether its text has had it before."""
        return ~_first_of(self.lines.text_of()[self.has_word], self.lines.hashes()[self.has_word])

    def _line_sizes(self) -> np.ndarray:
        """The code points of each line that has a word."""
        total = np.zeros(len(self._body) + 1, np.int64)
        np.cumsum(_CODE_POINT[self._body], out=total[1:])
        return (total[self.lines.end] - total[self.lines.start])[self.has_word]

    def _line_chars(self) -> np.ndarray:
        return np.bincount(self.lines.text_of()[self.has_word], self.line_sizes, len(self)).astype(np.int64)

    def _dup_line_chars(self) -> np.ndarray:
        return np.bincount(self.lines.text_of()[self.has_word], self.line_sizes * self.again_line, len(self)).astype(np.int64)

    def _n_dup_lines(self) -> np.ndarray:
        return np.bincount(self.lines.text_of()[self.has_word][self.again_line], minlength=len(self)).astype(np.int64)

    def _n_repeat_words(self) -> np.ndarray:
        """Words in runs of three words that the text has twice or more."""
        words = self.words
        text, count = words.text_of(), words.counts
        gram = grams(words.hashes(), 3)
        inside = np.flatnonzero(text[: len(gram)] == text[2:]) if len(gram) else np.zeros(0, np.int64)
        _, group, times = np.unique(gram[inside] ^ mix(text[inside].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        again = inside[times[group] > 1]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + 3, -1)
        return np.bincount(text[np.cumsum(step[:-1]) > 0], minlength=len(count)).astype(np.int64)


#: Statistics with one value for each text.
_COUNTED = {"n_words", "word_chars", "n_symbols", "n_digits", "line_chars", "dup_line_chars", "n_dup_lines", "n_repeat_words"}


def _first_of(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries are the first of their (text, value)."""
    out = np.zeros(len(text), dtype=bool)
    out[np.unique(value ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = True
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Statistics], np.ndarray]


#: Rules every text must pass.
BASE = (
    Rule("too_short", lambda s: s.n_words < 50),
    Rule("repeated_runs", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
#: The method's own rules, in integers so that SQL computes the same.
OWN = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("repeated_lines", lambda s: 10 * s.dup_line_chars > 3 * s.line_chars),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)),
    Rule("digits", lambda s: 2 * s.n_digits > s.word_chars),
)


@dataclass
class Sample:
    """What the rules do to the texts of a sample: by text the size and which rules reject it; by rule the
    statistics it asks for; by statistic the seconds (under a rule's name, those of the rule itself)."""

    size: np.ndarray
    rejected: np.ndarray  # (texts, rules)
    needs: list[set[str]]
    seconds: dict[str, float]


def measure(column: pa.Array, rules: tuple[Rule, ...]) -> Sample:
    size, rejected, needs, seconds = [np.zeros(0, np.int64)], [np.zeros((0, len(rules)), bool)], [set() for _ in rules], {}
    for _, _, body, at in chunks(column):
        s, found = Statistics(body, at), []
        for rule, need in zip(rules, needs):
            s._asked = []
            began, before = time.perf_counter(), sum(s._seconds.values())
            found.append(rule.rejects(s))
            seconds[rule.name] = seconds.get(rule.name, 0.0) + time.perf_counter() - began - (sum(s._seconds.values()) - before)
            need.update(s._asked, *(needs_of(s, name) for name in s._asked))
        for name, t in s._seconds.items():
            seconds[name] = seconds.get(name, 0.0) + t
        size.append(np.diff(at))
        rejected.append(np.stack(found, axis=1))
    return Sample(np.concatenate(size), np.concatenate(rejected), needs, seconds)


def needs_of(s: Statistics, name: str) -> set[str]:
    """The statistics that one is computed from."""
    again = Statistics(s._body[:0], s._at[:1])
    getattr(again, name)
    return set(again._had)


def order(sample: Sample, rules: tuple[Rule, ...], given: tuple[Rule, ...] = ()) -> list[Rule]:
    """The rules by rejection per cost, greedily: each is measured on what those before it, and the given ones, have passed.

    The sample has been measured by (*given, *rules).
    """
    every = [*given, *rules]
    live = ~sample.rejected[:, : len(given)].any(axis=1)
    had = set().union(*sample.needs[: len(given)])
    out, todo = [], list(range(len(given), len(every)))
    bytes_measured = max(1, int(sample.size.sum()))
    while todo and live.any():
        def worth(i: int) -> float:
            seconds = sum(sample.seconds.get(name, 0.0) for name in {every[i].name, *(sample.needs[i] - had)})
            return float(sample.rejected[live, i].mean()) / max(seconds / bytes_measured * float(sample.size[live].mean()), 1e-12)

        best = max(todo, key=worth)
        out.append(every[best])
        todo.remove(best)
        had |= sample.needs[best]
        live &= ~sample.rejected[:, best]
    return out + [every[i] for i in todo]


def survivors(s: Statistics, rules: list[Rule]) -> np.ndarray:
    """Which texts of a chunk pass all rules; each rule sees those that the rules before it have passed."""
    rows = np.arange(len(s))
    out = np.zeros(len(s), dtype=bool)
    for rule in rules:
        if not len(rows):
            return out
        passed = ~rule.rejects(s)
        s, rows = s.only(passed), rows[passed]
    out[rows] = True
    return out


def _measure_batches(rules: tuple[Rule, ...]):
    """One row for each batch: the sizes and masks of its texts, and what its statistics took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(0), rules)
            mask = (found.rejected << np.arange(len(rules))).sum(axis=1)
            row = {"size": [found.size], "mask": [mask], "needs": [[sorted(x) for x in found.needs]], "name": [list(found.seconds)], "seconds": [list(found.seconds.values())]}
            yield pa.RecordBatch.from_pydict(row, _SAMPLE)

    return run


_SAMPLE = pa.schema(
    [("size", pa.list_(pa.int64())), ("mask", pa.list_(pa.int64())), ("needs", pa.list_(pa.list_(pa.string()))), ("name", pa.list_(pa.string())), ("seconds", pa.list_(pa.float64()))]
)


def plan(docs: DataFrame, rules: tuple[Rule, ...], given: tuple[Rule, ...] = (), text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order measured on about `sample_rows` texts that the given rules pass or not."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    every = (*given, *rules)
    schema = "size array<long>, mask array<long>, needs array<array<string>>, name array<string>, seconds array<double>"
    rows = texts.sample(False, share, 7).mapInArrow(_measure_batches(every), schema).collect()
    needs, seconds = [set() for _ in every], {}
    for row in rows:
        for need, more in zip(needs, row.needs):
            need.update(more)
        for name, t in zip(row.name, row.seconds):
            seconds[name] = seconds.get(name, 0.0) + t
    size, mask = (np.array([x for row in rows for x in row[c]], np.int64) for c in ("size", "mask"))
    return order(Sample(size, (mask[:, None] >> np.arange(len(every)) & 1).astype(bool), needs, seconds), rules, given)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge_batches(own: list[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, at in chunks(batch.column(1)):
                s = Statistics(body, at)
                failed = np.zeros(len(s), dtype=bool)
                for rule in BASE:
                    failed |= rule.rejects(s)
                kept = np.zeros(len(s), dtype=bool)
                kept[~failed] = survivors(s.only(~failed), own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(getattr(s, c), pa.int64()) for c in _COUNTS), pa.array(failed), pa.array(kept)],
                    names=["id", *_COUNTS, "base_failed", "kept"],
                )

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, statistics of the base rules, base_failed, kept): one row for each row of `docs`."""
    ship(docs.sparkSession)
    own = plan(docs, OWN, BASE, text_col, sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(_judge_batches(own), f"id {dict(rows.dtypes)['id']}, {counts}, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)


def _keep_batches(rules: list[Rule], position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [survivors(Statistics(body, at), rules) for _, _, body, at in chunks(batch.column(position))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool)))

    return run


def keep(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    ship(docs.sparkSession)
    rules = plan(docs, BASE + OWN, (), text_col, sample_rows)
    return docs.mapInArrow(_keep_batches(rules, docs.columns.index(text_col)), docs.schema)
