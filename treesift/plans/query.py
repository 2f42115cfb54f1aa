"""What a query string means: terms, filters and options."""

from __future__ import annotations

from dataclasses import dataclass, field

EXACT, FUZZY, WILDCARD, REGEX = "exact", "fuzzy", "wildcard", "regex"
MODES = (EXACT, FUZZY, WILDCARD, REGEX)
NAME, PATH = "name", "path"
SORTS = ("name", "path", "size", "modified", "created", "relevance", "runcount")
#: Sorts whose best comes first unless asked otherwise.
DESCENDING = ("size", "modified", "created", "relevance", "runcount")


@dataclass(frozen=True)
class Term:
    text: str
    scope: str = NAME
    glob: bool = False


@dataclass(frozen=True)
class Group:
    """Alternatives of which one must match or, if negated, none may."""

    terms: tuple[Term, ...]
    negated: bool = False


@dataclass
class ParsedQuery:
    groups: list[Group] = field(default_factory=list)
    case_sensitive: bool = False
    whole_word: bool = False
    dupes: bool = False
    empty_dirs: bool = False
    only_dirs: bool = False
    only_files: bool = False
    exts: list[str] = field(default_factory=list)
    not_exts: list[str] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    not_types: list[int] = field(default_factory=list)
    sizes: list[tuple[str, int]] = field(default_factory=list)
    not_sizes: list[tuple[str, int]] = field(default_factory=list)
    lengths: list[tuple[str, int]] = field(default_factory=list)
    date_from: int | None = None
    date_to: int | None = None
    not_dates: list[tuple[int | None, int | None]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    not_prefixes: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    not_suffixes: list[str] = field(default_factory=list)
    content: str | None = None
    tags: list[list[str]] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return self == ParsedQuery(case_sensitive=self.case_sensitive, whole_word=self.whole_word)


@dataclass(frozen=True)
class SearchOptions:
    folders_first: bool = False
    hide_hidden: bool = False
    folder_sizes: bool = True
    whole_name_wildcards: bool = True
    content_budget: int = 200_000
    content_max_bytes: int = 64 << 20
    zone: str = "UTC"
