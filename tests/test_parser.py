import pytest

from treesift.functions.literals import INT64_MAX, date_filter, length_filter, size_filter
from treesift.plans.parser import build_query, parse, tokenize, with_chip
from treesift.plans.query import NAME, PATH, Group, Term

NOW = 1_706_659_200.0
DAY = 86_400 * 10**9


def group(*texts, negated=False, scope=NAME, glob=False):
    return Group(tuple(Term(t, scope, glob) for t in texts), negated)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a b", [("a", False), ("b", False)]),
        ('"a b" c', [("a b", True), ("c", False)]),
        ('x"a b"y z', [("xa by", True), ("z", False)]),
        ('"" a b', [("a", True), ("b", False)]),
        ("a\tb  c", [("a\tb", False), ("c", False)]),
        ('"a b', [("a b", True)]),
        ("", []),
    ],
)
def test_tokens(raw, want):
    assert tokenize(raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Report", [group("report")]),
        ("a|b||c", [group("a", "b", "c")]),
        ("-a !b NOT c not -d", [group(x, negated=True) for x in "abcd"]),
        ("a NOT", [group("a")]),
        ("-", [group("-")]),
        ("path:A|b name:c", [group("a", "b", scope=PATH), group("c")]),
        ("path: name:", []),
        ('path:"a b"', [group("path:a b")]),
        ('-"a b"', [group("-a b")]),
        ('NOT "a b"', [group("a b", negated=True)]),
        ('"x*y"', [group("x*y")]),
        ("x*y|z", [Group((Term("x*y", NAME, True), Term("z", NAME, False)))]),
        ("foo:bar", [group("foo:bar")]),
        ("size:=5 size:abc type:none dm:>=2024-01-01 len:x", [group(t) for t in ("size:=5", "size:abc", "type:none", "dm:>=2024-01-01", "len:x")]),
        ("CAFÉ", [group("cafe")]),
        ("folder:a*b|c", [group("a*b|c")]),
        ("-file:x", [group("x", negated=True)]),
        (":a", [group(":a")]),
    ],
)
def test_groups(raw, want):
    assert parse(raw).groups == want


def test_case_sensitivity_holds_for_all_terms():
    q = parse("Ab case:on cD")
    assert q.case_sensitive and [g.terms[0].text for g in q.groups] == ["Ab", "cD"]
    assert parse("case:off Ab").groups == [group("ab")] and not parse("case:off").case_sensitive
    assert not parse('"case:on" A').case_sensitive


def test_filters():
    q = parse("ext:.PDF,md -ext:png type:images,video -kind:audio size:>1kb -size:<10 len:3..8 startwith:Ré -endwith:.TXT")
    assert (q.exts, q.not_exts, q.types, q.not_types) == (["pdf", "md"], ["png"], [2 | 8], [4])
    assert (q.sizes, q.not_sizes, q.lengths) == ([(">", 1024)], [("<", 10)], [(">=", 3), ("<=", 8)])
    assert (q.prefixes, q.not_suffixes) == (["re"], [".txt"])
    q = parse("ww: dupe: empty: content:Ab content:cD tag:Red;blue t:x ext:.")
    assert q.whole_word and q.dupes and q.empty_dirs and q.only_dirs
    assert (q.content, q.tags, q.exts) == ("cD", [["red", "blue"], ["x"]], [""])
    q = parse("-ww: -dupe: -empty: -len:3 -content:a -tag:a")
    assert q.is_empty


def test_type_restrictions():
    assert parse("folder:").only_dirs and parse("-folder:").only_files and parse("-file:").only_dirs
    q = parse("-folder:x")
    assert not q.only_dirs and not q.only_files and q.groups == [group("x", negated=True)]
    q = parse("folder:x")
    assert q.only_dirs and q.groups == [group("x")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("10", ("=", 10)), (">1kb", (">", 1024)), ("<=1.5m", ("<=", 1572864)), (">=2GB", (">=", 2 << 30)), ("0.5b", ("=", 1)), ("1e400", None), ("nan", None),
        ("inf", None), ("9e99", ("=", INT64_MAX)), ("=5", None), ("", None), ("5..6", None), ("-3", ("=", -3)), ("1e3k", ("=", 1024000)),
    ],
)
def test_sizes(text, want):
    assert size_filter(text) == want


@pytest.mark.parametrize("text, want", [("5", [("=", 5)]), ("=5", [("=", 5)]), (">=3", [(">=", 3)]), ("3..8", [(">=", 3), ("<=", 8)]), ("3..", None), ("a", None), ("1k", None)])
def test_lengths(text, want):
    assert length_filter(text) == want


def test_dates():
    today = int(NOW) * 10**9
    assert date_filter("today", NOW) == (today, today + DAY) == date_filter("2024-01-31", NOW + 3600)
    assert date_filter("yesterday", NOW) == (today - DAY, today)
    assert date_filter("WEEK", NOW) == date_filter("thisweek", NOW) == (today - 7 * DAY, today + DAY)
    assert date_filter("month", NOW) == (today - 30 * DAY, today + DAY)
    assert date_filter(">2024-01-31", NOW) == (today + DAY, None) and date_filter("<2024-01-31", NOW) == (None, today)
    assert date_filter("9999-01-01", NOW) == (INT64_MAX, INT64_MAX)
    assert all(date_filter(t, NOW) is None for t in ("", "2024-13-01", "2024-02-30", ">=2024-01-01", "tomorrow"))
    assert date_filter("2024-01-31", NOW, "Europe/Paris") == (today - 3600 * 10**9, today - 3600 * 10**9 + DAY)
    q = parse("dm:>2024-01-01 dm:<2024-01-31 -dm:today", now=NOW)
    assert q.date_from is not None and q.date_to == today and q.not_dates == [(today, today + DAY)]


def test_chips_and_forms():
    assert with_chip("a", "images", case_sensitive=True) == "file: type:images case:on a"
    assert with_chip("a") == "a" and with_chip("", "folders", whole_word=True) == "folder: ww:"
    made = build_query(name="a b", ext="pdf, md", path="x y", size_min="1", size_max="z", unit="mb", kind="files", modified="today")
    assert made == '"a b" ext:pdf,md path:x path:y size:>=1mb file: dm:today'
    assert [g.terms[0].scope for g in parse(made).groups] == [NAME, PATH, PATH]
