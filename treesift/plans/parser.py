"""The query language.  Parsing never fails: what no rule takes is a plain term.

Tokens are split at spaces; quotes group, and a token that had a quote is a literal phrase.  `NOT`, `-`
and `!` negate.  `key:value` is a filter if the key is known and takes the value.  `a|b` are
alternatives, `name:` and `path:` choose what a term is compared with, and `*` or `?` in an unquoted
term make it a pattern for the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions.literals import date_filter, length_filter, size_filter
from ..functions.text import ascii_lower, category_mask, nfc, search_fold
from .query import NAME, PATH, Group, ParsedQuery, Term


def tokenize(raw: str) -> list[tuple[str, bool]]:
    """(token, whether it is a phrase).  An empty pair of quotes makes a phrase of the token after it."""
    out: list[tuple[str, bool]] = []
    quoted = False
    pieces = raw.split('"')
    token = ""
    for i, piece in enumerate(pieces):
        if i:
            quoted = True
        if i % 2:  # between quotes
            token += piece
            continue
        *ended, rest = piece.split(" ")
        for part in ended:
            token += part
            if token:
                out.append((token, quoted))
                token, quoted = "", False
        token += rest
    if token:
        out.append((token, quoted))
    return out


@dataclass
class _Context:
    query: ParsedQuery
    now: float
    zone: str

    def fold(self, text: str) -> str:
        return nfc(text) if self.query.case_sensitive else search_fold(nfc(text))


Filter = Callable[[_Context, str, bool], bool]
FILTERS: dict[str, Filter] = {}


def _filter(*keys: str) -> Callable[[Filter], Filter]:
    def register(f: Filter) -> Filter:
        FILTERS.update(dict.fromkeys(keys, f))
        return f

    return register


@_filter("case")
def _case(c: _Context, value: str, negated: bool) -> bool:
    return True  # `case:on` is looked for before all tokens


@_filter("ext", "exts")
def _ext(c: _Context, value: str, negated: bool) -> bool:
    found = [ascii_lower(part.removeprefix(".")) for part in value.split(",") if part]
    (c.query.not_exts if negated else c.query.exts).extend(found)
    return True


@_filter("type", "kind")
def _type(c: _Context, value: str, negated: bool) -> bool:
    if mask := category_mask(value):
        (c.query.not_types if negated else c.query.types).append(mask)
    return bool(mask)


@_filter("size")
def _size(c: _Context, value: str, negated: bool) -> bool:
    found = size_filter(value)
    if found:
        (c.query.not_sizes if negated else c.query.sizes).append(found)
    return found is not None


@_filter("dm", "modified", "date")
def _date(c: _Context, value: str, negated: bool) -> bool:
    found = date_filter(value, c.now, c.zone)
    if found is None:
        return False
    first, last = found
    if negated:
        c.query.not_dates.append(found)
    else:  # a later filter replaces the bounds that it sets
        c.query.date_from = first if first is not None else c.query.date_from
        c.query.date_to = last if last is not None else c.query.date_to
    return True


@_filter("len", "length")
def _length(c: _Context, value: str, negated: bool) -> bool:
    found = length_filter(value)
    if found and not negated:
        c.query.lengths.extend(found)
    return found is not None


@_filter("ww", "wholeword")
def _whole_word(c: _Context, value: str, negated: bool) -> bool:
    c.query.whole_word |= not negated
    return True


@_filter("dupe", "dupes", "dup")
def _dupes(c: _Context, value: str, negated: bool) -> bool:
    c.query.dupes |= not negated
    return True


@_filter("empty")
def _empty(c: _Context, value: str, negated: bool) -> bool:
    c.query.empty_dirs |= not negated
    c.query.only_dirs |= not negated
    return True


def _affix(positive: str, negative: str) -> Filter:
    def take(c: _Context, value: str, negated: bool) -> bool:
        if value:
            getattr(c.query, negative if negated else positive).append(c.fold(value))
        return True

    return take


_filter("startwith", "startswith", "prefix")(_affix("prefixes", "not_prefixes"))
_filter("endwith", "endswith", "suffix")(_affix("suffixes", "not_suffixes"))


@_filter("content")
def _content(c: _Context, value: str, negated: bool) -> bool:
    if value and not negated:
        c.query.content = value
    return True


@_filter("tag", "t")
def _tag(c: _Context, value: str, negated: bool) -> bool:
    wanted = [part.lower() for part in value.split(";") if part]
    if wanted and not negated:
        c.query.tags.append(wanted)
    return True


def _entry_type(own: str, other: str) -> Filter:
    """A bare filter restricts the type, or if negated to the other; a value is a name term of its own."""

    def take(c: _Context, value: str, negated: bool) -> bool:
        if not (value and negated):
            setattr(c.query, other if negated else own, True)
        if value:
            c.query.groups.append(Group((Term(c.fold(value), NAME),), negated))
        return True

    return take


_filter("folder", "folders", "dir")(_entry_type("only_dirs", "only_files"))
_filter("file", "files")(_entry_type("only_files", "only_dirs"))


def parse(raw: str, default_scope: str = NAME, now: float = 0.0, zone: str = "UTC") -> ParsedQuery:
    tokens = tokenize(raw)
    query = ParsedQuery(case_sensitive=any(not quoted and token.lower() in ("case:on", "case:") for token, quoted in tokens))
    context = _Context(query, now, zone)
    negate_next = False
    for token, quoted in tokens:
        if not quoted and token.lower() == "not":
            negate_next = True
            continue
        negated, negate_next = negate_next, False
        if quoted:
            query.groups.append(Group((Term(context.fold(token), default_scope),), negated))
            continue
        if len(token) > 1 and token[0] in "-!":
            negated, token = True, token[1:]
        key, colon, value = token.partition(":")
        if colon and key and (take := FILTERS.get(key.lower())) and take(context, value, negated):
            continue
        scope = default_scope
        if colon and key.lower() in (NAME, PATH):
            scope, token = key.lower(), value
        terms = tuple(Term(context.fold(part), scope, "*" in part or "?" in part) for part in token.split("|") if part)
        if terms:
            query.groups.append(Group(terms, negated))
    return query


#: Type chips of a search form and the clause that each puts before the query.
CHIPS = {"all": "", "folders": "folder:", "files": "file:"} | {c: f"file: type:{c}" for c in ("documents", "images", "audio", "video", "archives", "apps")}


def with_chip(query: str, chip: str = "all", case_sensitive: bool = False, whole_word: bool = False) -> str:
    """The query with the clauses of a type chip and of toggles before it."""
    return " ".join(p for p in (CHIPS[chip], "case:on" * case_sensitive, "ww:" * whole_word, query.strip()) if p)


def build_query(name: str = "", ext: str = "", path: str = "", size_min: str = "", size_max: str = "", unit: str = "", kind: str = "any", modified: str = "", case_sensitive: bool = False) -> str:
    """A query string from the fields of a form.

    A path with spaces becomes one `path:` term for each word, as a quoted value would be a literal.
    """
    name, ext, path = name.strip(), ext.replace(" ", ""), path.strip()
    parts = [f'"{name}"' if " " in name else name, f"ext:{ext}" if ext else "", *(f"path:{p}" for p in path.split())]
    for op, size in ((">=", size_min.strip()), ("<=", size_max.strip())):
        if size and size_filter(size):
            parts.append(f"size:{op}{size}{unit}")
    parts += [{"any": "", "files": "file:", "folders": "folder:"}[kind], f"dm:{modified}" if modified else "", "case:on" if case_sensitive else ""]
    return " ".join(p for p in parts if p)
