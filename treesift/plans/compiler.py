"""From a parsed query to Column predicates and a match score over `entries`.

Every predicate is a built-in expression over stored columns, so scans prune and Catalyst orders and
fuses them; only the scores of fuzzy matches leave the JVM, after the filter.  `name_ufold` and `ext`
are null for most rows: predicates on them count null as no match before they are negated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from ..functions import scoring
from ..operators.ingest import glob_like, under
from .query import EXACT, FUZZY, PATH, WILDCARD, Group, ParsedQuery, SearchOptions, Term

_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_COMPARE = {
    "=": lambda c, n: c == n,
    ">": lambda c, n: c > n,
    "<": lambda c, n: c < n,
    ">=": lambda c, n: c >= n,
    "<=": lambda c, n: c <= n,
}


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(False))


def literal_pattern(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def whole_word_pattern(text: str) -> str:
    return f"(?<![{_WORD}]){literal_pattern(text)}(?![{_WORD}])"


def subsequence_like(text: str) -> str:
    return "%" + "%".join("|" + c if c in "%_|" else c for c in text) + "%"


class TermPlan:
    """How one term is compared: the columns it may match, a predicate and a score for each."""

    def __init__(self, term: Term, query: ParsedQuery, mode: str, options: SearchOptions):
        self.text = term.text
        self.glob = term.glob or mode == WILDCARD
        self.fuzzy = mode == FUZZY and not self.glob
        self.whole_word = query.whole_word and mode == EXACT and not self.glob
        self.pattern = term.text if options.whole_name_wildcards else f"*{term.text}*"
        if term.scope == PATH:
            self.columns = [("path" if query.case_sensitive else "path_ufold", None)]
        elif query.case_sensitive:
            self.columns = [("name", "name")]
        else:
            self.columns = [("name_fold", "name"), ("name_ufold", None)]

    def _matches(self, column: str) -> Column:
        hay = F.col(column)
        if self.glob:
            return F.like(hay, F.lit(glob_like(self.pattern)), F.lit("|"))
        if self.fuzzy:
            return F.like(hay, F.lit(subsequence_like(self.text)), F.lit("|"))
        if self.whole_word:
            return F.rlike(hay, F.lit(whole_word_pattern(self.text)))
        return F.contains(hay, F.lit(self.text))

    def _score(self, column: str, cased: str | None) -> Column:
        hay = F.col(column)
        if self.glob:
            return scoring.pattern_score(hay)
        if self.fuzzy:
            return scoring.fuzzy_score(self.text)(hay, F.col(cased) if cased else F.lit(None).cast("string"))
        if self.whole_word:
            return scoring.whole_word_score(hay, F.regexp_instr(hay, F.lit(whole_word_pattern(self.text))))
        return scoring.exact_score(hay, self.text, F.col(cased) if cased else None)

    def predicate(self) -> Column:
        return any_of([self._matches(c) for c, _ in self.columns])

    def score(self) -> Column:
        """The better of the columns' scores; null without a match."""
        found = [F.when(self._matches(c), self._score(c, cased)) for c, cased in self.columns]
        return F.greatest(*found) if len(found) > 1 else found[0]


def group_predicate(group: Group, query: ParsedQuery, mode: str, options: SearchOptions) -> Column:
    hit = any_of([TermPlan(t, query, mode, options).predicate() for t in group.terms])
    return ~hit if group.negated else hit


def match_score(query: ParsedQuery, mode: str, options: SearchOptions) -> Column:
    """Of each positive group the score of its first alternative that matches, added up."""
    total = F.lit(0)
    for group in query.groups:
        if not group.negated:
            total = total + F.coalesce(*(TermPlan(t, query, mode, options).score() for t in group.terms), F.lit(0))
    return total


def _affixes(texts: list[str], query: ParsedQuery, test: str) -> tuple[list[Column], list[Column]]:
    """Each text's test on the plain spelling, and on the one without accents."""
    plain = "name" if query.case_sensitive else "name_fold"
    first = [getattr(F.col(plain), test)(F.lit(t)) for t in texts]
    second = [] if query.case_sensitive else [getattr(F.col("name_ufold"), test)(F.lit(t)) for t in texts]
    return first, second


def _within(column: str, bounds: tuple[int | None, int | None]) -> Column:
    first, last = bounds
    parts = ([F.col(column) >= first] if first is not None else []) + ([F.col(column) < last] if last is not None else [])
    return reduce(and_, parts, F.lit(True))


def filters(query: ParsedQuery, mode: str = EXACT, options: SearchOptions = SearchOptions(), scope_root: str | None = None) -> list[Column]:
    """All conditions of a query but for contents and tags, cheap ones first."""
    out: list[Column] = []
    acts_as_dir = F.col("is_dir") & ~F.col("is_package")
    if scope_root:
        out.append(under(F.col("path"), scope_root))
    if query.only_dirs:
        out.append(acts_as_dir)
    if query.only_files:
        out.append(~acts_as_dir)
    if query.dupes:
        out.append(F.col("is_dupe"))
    if query.empty_dirs:
        out.append(F.col("is_empty_dir"))
    if query.exts:
        out.append(F.col("ext").isin(query.exts))  # bare, so that scans can prune by it; null counts as no match here
    if query.not_exts:
        out.append(~F.coalesce(F.col("ext").isin(query.not_exts), F.lit(False)))
    out += [F.col("type_mask").bitwiseAND(F.lit(m)) != 0 for m in query.types]
    out += [F.col("type_mask").bitwiseAND(F.lit(m)) == 0 for m in query.not_types]
    out += [_COMPARE[op](F.col("size"), n) for op, n in query.sizes]
    out += [~_COMPARE[op](F.col("size"), n) for op, n in query.not_sizes]
    if query.date_from is not None or query.date_to is not None:
        out.append(_within("mtime_ns", (query.date_from, query.date_to)))
    out += [~_within("mtime_ns", bounds) for bounds in query.not_dates]
    out += [_COMPARE[op](F.octet_length("name"), n) for op, n in query.lengths]
    for wanted, unwanted, test in ((query.prefixes, query.not_prefixes, "startswith"), (query.suffixes, query.not_suffixes, "endswith")):
        if wanted:  # all of them on one spelling
            spellings = [reduce(and_, s) for s in _affixes(wanted, query, test) if s]
            out.append(any_of(spellings))
        if unwanted:
            first, second = _affixes(unwanted, query, test)
            out.append(~any_of(first + second))
    return out + [group_predicate(g, query, mode, options) for g in query.groups]


def implies(new: Group, old: Group) -> bool:
    """Whether, by the texts alone, what the new group lets through the old one did too."""
    if new.negated != old.negated or any(t.glob for t in (*new.terms, *old.terms)):
        return new == old
    contains = lambda long, short: long.scope == short.scope and short.text in long.text
    if new.negated:  # every text that was excluded still is
        return all(any(contains(o, n) for n in new.terms) for o in old.terms)
    return all(any(contains(n, o) for o in old.terms) for n in new.terms)


def narrows(new: ParsedQuery, old: ParsedQuery) -> bool:
    """Whether every match of the new query surely is one of the old query (both in exact mode)."""
    if new.case_sensitive != old.case_sensitive or old.whole_word and not new.whole_word or old.content or old.tags:
        return False
    if old.whole_word and any(g not in new.groups for g in old.groups):
        return False  # a longer text may hold a word that is none of its own
    flags = ("dupes", "empty_dirs", "only_dirs", "only_files")
    if any(getattr(old, f) and not getattr(new, f) for f in flags):
        return False
    added = ("types", "not_types", "sizes", "not_sizes", "lengths", "not_dates", "prefixes", "not_prefixes", "suffixes", "not_suffixes", "not_exts")
    if any(x not in getattr(new, f) for f in added for x in getattr(old, f)):
        return False
    if old.exts and not (new.exts and set(new.exts) <= set(old.exts)):
        return False
    if old.date_from is not None and (new.date_from is None or new.date_from < old.date_from):
        return False
    if old.date_to is not None and (new.date_to is None or new.date_to > old.date_to):
        return False
    return all(any(implies(n, o) for n in new.groups) for o in old.groups)
