"""The registered queries over the sample tree, each with the same in DuckDB SQL where SQL can say it.

Every ordered result has its rank as a column.  The clock is fixed (`tables.NOW`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .api import Engine
from .functions import fingerprint, highlight, scoring
from .functions.text import kind, shown_extension
from .operators import diff, history, tree
from .operators.ingest import select_listing
from .operators.search import refine, search
from .plans.query import SearchOptions
from .sources import export, listing as listings, snapshot, tables
from .sources.keep import keep, shared_folder
from .sources.tables import CONTENTS_SQL, ENTRIES_SQL, HISTORY_SQL, NOW, TAGS_SQL
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_entries: dict[tuple[str, str], DataFrame] = {}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the sample tree, kept by the session (on disk where memory ends)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _entries:
        _entries[key] = tables.entries(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _entries[key]


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _day(text: str) -> int:
    from datetime import datetime, timezone

    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 10**9


BY_NAME, BY_NAME_DOWN = "name_fold, depth, path", "name_fold DESC, depth DESC, path DESC"
_TODAY = int(NOW) * 10**9
_DAY_NS = 86_400 * 10**9
_DIRLIKE = "(is_dir AND NOT is_package)"


def _name(text: str) -> str:
    return f"(contains(name_fold, '{text}') OR coalesce(contains(name_ufold, '{text}'), false))"


def _name_like(pattern: str) -> str:
    return f"(name_fold LIKE '{pattern}' ESCAPE '|' OR coalesce(name_ufold LIKE '{pattern}' ESCAPE '|', false))"


def _word(text: str) -> str:
    edge = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
    return "(" + " OR ".join(f"coalesce(regexp_matches({c}, '(?:^|{edge}){text}(?:$|{edge})'), false)" for c in ("name_fold", "name_ufold")) + ")"


def _search(name: str, query: str, where: str | None, order: str = BY_NAME, extra: str = "", columns: tuple[str, ...] = (), **arguments) -> None:
    """Registers a search: its paths and their rank; all of them (`limit=None`) where its SQL has no LIMIT."""
    limit = arguments.get("limit", 100_000)
    needs = {"history": tables.history, "contents": tables.contents, "tags": tables.tags}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {k: needs[k](spark, sf_dir) if k in needs else v for k, v in arguments.items()}
        return search(entries(spark, sf_dir), query, now=NOW, **given).ranked().select("path", "rank", *columns)

    picked = "".join(f", {c}" for c in columns)
    sql = None if where is None else f"{ENTRIES_SQL}{extra} SELECT path, row_number() OVER (ORDER BY {order}) AS rank{picked} FROM entries WHERE {where} ORDER BY {order} LIMIT {limit}"
    register(name, run, sql)


# Terms
_search("term_exact", "report", _name("report"))
_search("term_and", "report pdf", f"{_name('report')} AND {_name('pdf')}")
_search("term_or", "note|inner|", f"({_name('note')} OR {_name('inner')})")
_search("term_not", "report -pdf", f"{_name('report')} AND NOT {_name('pdf')}")
_search("term_not_keyword", "report NOT ext:pdf", f"{_name('report')} AND coalesce(ext <> 'pdf', true)")
_search("term_not_group", "!report|note folder:", f"NOT ({_name('report')} OR {_name('note')}) AND {_DIRLIKE}")
_search("term_phrase", '"small widget"', _name("small widget"))
_search("term_casesensitive", "case:on Report", "contains(name, 'Report')")
_search("term_unknown_filter", "foo:bar", _name("foo:bar"))
_search("glob_auto", "report_1*.p?f", _name_like("report|_1%.p_f"))
_search("glob_unanchored", "ort_1?.", _name_like("%ort|_1_.%"), options=SearchOptions(whole_name_wildcards=False), mode="wildcard")
_search("glob_mode", "inner.bin", _name_like("inner.bin"), mode="wildcard")
_search("whole_word", "ww: report", _word("report"))
_search("whole_word_not", "ww: ext:pdf -report", f"ext = 'pdf' AND NOT {_word('report')}")
_search("regex_name", r"^note_\d+\.p", r"regexp_matches(name, '(?i)^note_\d+\.p')", mode="regex")
_search("regex_path", r"/src[12]/.*\.md$", r"regexp_matches(path, '(?i)/src[12]/.*\.md$')", mode="regex", scope="path")
_search("regex_invalid", "[", "false", mode="regex")
_search("fold_accent", "ecole|etre|ion", f"({_name('ecole')} OR {_name('etre')} OR {_name('ion')})")
_search("path_scope", "path:corpus/src1 ext:md", "contains(path_ufold, 'corpus/src1') AND ext = 'md'")
_search("name_override", "name:report", _name("report"), scope="path")
_search("path_mode", "web -fr", "contains(path_ufold, 'web') AND NOT contains(path_ufold, 'fr')", scope="path")
_search("fuzzy_set", "rprt", _name_like("%r%p%r%t%"), mode="fuzzy")
_search("fuzzy_rank", "nt1 swift", None, mode="fuzzy", sort="relevance", ascending=False, columns=("score",), limit=None)

# Filters
_search("ext_in", "ext:pdf,.MD", "ext IN ('pdf', 'md')")
_search("ext_not", "-ext:png file:", "coalesce(ext <> 'png', true) AND NOT " + _DIRLIKE)
_search("ext_trailing_dot", "ext:.", "ext = ''")
_search("type_category", "type:documents", "(type_mask & 1) <> 0")
_search("type_overlap", "type:archives type:apps", "(type_mask & 16) <> 0 AND (type_mask & 32) <> 0")
_search("type_not", "-type:documents,images file:", f"(type_mask & 3) = 0 AND NOT {_DIRLIKE}")
_search("type_equiv_ext", "file: ext:app,pkg,dmg,exe", f"(type_mask & 32) <> 0 AND NOT {_DIRLIKE}")
_search("size_cmp", "size:>1kb size:<=10k", "size > 1024 AND size <= 10240")
_search("size_not", "-size:<4.5kb file:", f"NOT size < 4608 AND NOT {_DIRLIKE}")
_search("date_today", "dm:today", f"mtime_ns >= {_TODAY} AND mtime_ns < {_TODAY + _DAY_NS}")
_search("date_range", "dm:>2024-01-04 dm:<2024-01-15", f"mtime_ns >= {_day('2024-01-05')} AND mtime_ns < {_day('2024-01-15')}")
_search("date_week", "dm:week", f"mtime_ns >= {_TODAY - 7 * _DAY_NS} AND mtime_ns < {_TODAY + _DAY_NS}")
_search("date_not", "-dm:2024-01-10 file:", f"NOT (mtime_ns >= {_day('2024-01-10')} AND mtime_ns < {_day('2024-01-11')}) AND NOT {_DIRLIKE}")
_search("len_range", "len:3..8", "strlen(name) >= 3 AND strlen(name) <= 8")
_search("len_cmp", "len:>=24", "strlen(name) >= 24")
_search("affix_prefix", "startwith:rep", "(starts_with(name_fold, 'rep') OR coalesce(starts_with(name_ufold, 'rep'), false))")
_search("affix_suffix", "endwith:.MD prefix:n", "(starts_with(name_fold, 'n') OR coalesce(starts_with(name_ufold, 'n'), false)) AND (ends_with(name_fold, '.md') OR coalesce(ends_with(name_ufold, '.md'), false))")
_search("affix_not", "-startwith:rep -endwith:.md file:", f"NOT starts_with(name_fold, 'rep') AND NOT coalesce(starts_with(name_ufold, 'rep'), false) AND NOT ends_with(name_fold, '.md') AND NOT coalesce(ends_with(name_ufold, '.md'), false) AND NOT {_DIRLIKE}")
_search("kind_folder", "folder:", _DIRLIKE)
_search("kind_folder_named", "folder:src", f"{_DIRLIKE} AND {_name('src')}")
_search("kind_file", "-folder:", f"NOT {_DIRLIKE}")
_search("package_as_file", "file: ext:bundle", f"NOT {_DIRLIKE} AND ext = 'bundle'")
_search("dupe_names", "dupe: ext:jpg", "is_dupe AND ext = 'jpg'")
_search("empty_dirs", "empty:", f"is_empty_dir AND {_DIRLIKE}")
_search("scope_subtree", "", "(path = '/corpus/src0' OR starts_with(path, '/corpus/src0/'))", scope_root="/corpus/src0")
_search("scope_missing", "report", "false", scope_root="/no/such/folder")
_search("hide_hidden", "report|supplier", f"({_name('report')} OR {_name('supplier')}) AND NOT is_hidden", options=SearchOptions(hide_hidden=True))
_search("content_search", "ext:txt content:THE", "ext = 'txt' AND NOT is_dir AND (flags & 1073741824) = 0 AND path IN (SELECT path FROM contents WHERE contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the'))", extra=", " + CONTENTS_SQL, contents=True)
_search("tag_filter", "tag:en;fr t:src1", "path IN (SELECT path FROM named WHERE (contains(lower(split_part(tags[1], chr(10), 1)), 'en') OR contains(lower(split_part(tags[1], chr(10), 1)), 'fr') OR contains(lower(tags[2]), 'en') OR contains(lower(tags[2]), 'fr')) AND (contains(lower(split_part(tags[1], chr(10), 1)), 'src1') OR contains(lower(tags[2]), 'src1')))", extra=", " + TAGS_SQL, tags=True)

# Orders
_SIZE = "CASE WHEN is_dir THEN subtree_size ELSE size END"
_search("order_name", "", "true", limit=500)
_search("order_name_desc", "report", _name("report"), BY_NAME_DOWN, ascending=False)
_search("order_path", "ext:md", "ext = 'md'", "path_fold, depth, path", sort="path")
_search("order_size_folder", "", "true", f"{_SIZE} DESC, depth DESC, path DESC", sort="size", ascending=False, limit=300)
_search("order_size_raw", "", "true", "size DESC, depth DESC, path DESC", sort="size", ascending=False, limit=300, options=SearchOptions(folder_sizes=False))
_search("order_modified_desc", "report", _name("report"), "mtime_ns DESC, depth DESC, path DESC", sort="modified", ascending=False)
_search("order_created", "note", _name("note"), "crtime_ns, depth, path", sort="created")
_search("order_folders_first", "c", _name("c"), f"{_DIRLIKE} DESC, {BY_NAME}", options=SearchOptions(folders_first=True))
_search("topk_limit", "ext:pdf,png", "ext IN ('pdf', 'png')", "size DESC, depth DESC, path DESC", sort="size", ascending=False, limit=25)
_search("relevance_empty", "", "true", BY_NAME_DOWN, sort="relevance", ascending=False, limit=200)
_RECENT = f"CASE WHEN mtime_ns >= {_TODAY - 3600 * 10**9} THEN 60 WHEN mtime_ns >= {_TODAY - _DAY_NS} THEN 40 WHEN mtime_ns >= {_TODAY - 7 * _DAY_NS} THEN 20 ELSE 0 END"
_search("relevance_filter_only", "ext:md", "ext = 'md'", f"{_RECENT} * 64 - least(depth, 16) DESC, {BY_NAME}", sort="relevance", ascending=False)
_search("relevance_glob", "report_*", _name_like("report|_%"), f"(greatest(1, 700 - strlen(name_fold)) + {_RECENT}) * 64 - least(depth, 16) DESC, {BY_NAME}", sort="relevance", ascending=False)


def _exact_sql(hay: str, cased: str | None, p: str, needle: str) -> tuple[list[str], str]:
    """(columns to compute in turn, score) of the exact score of a term, by the same definition in SQL."""
    places = [f"coalesce(instr({hay}, '{needle}'), 0) AS {p}1"]
    places += [f"CASE WHEN {p}{i} > 0 AND instr({hay}[{p}{i} + 1:], '{needle}') > 0 THEN {p}{i} + instr({hay}[{p}{i} + 1:], '{needle}') ELSE 0 END AS {p}{i + 1}" for i in range(1, 5)]

    def at(i: int) -> str:
        return f"strlen({hay}[1:{p}{i} - 1])"

    def boundary(i: int) -> str:
        hump = f" OR (regexp_matches({cased}[{p}{i} - 1:{p}{i}], '^[a-z0-9][A-Z]$') AND {at(i)} < 64)" if cased else ""
        return f"({hay}[{p}{i} - 1:{p}{i} - 1] IN ('/', '_', '-', '.', ' '){hump})"

    def score(i: int, bonus: int) -> str:
        return f"{1000 + bonus} - least({at(i)}, 900)"

    later = " ".join(f"WHEN {p}{i} > 0 AND {boundary(i)} THEN {score(i, 60)}" for i in range(2, 6))
    best = f"CASE WHEN {p}1 = 1 THEN {score(1, 150)} WHEN {boundary(1)} THEN {score(1, 60)} ELSE greatest({score(1, 0)}, CASE {later} END) END"
    return places, f"CASE WHEN {p}1 > 0 THEN {best} + greatest(0, 40 - (strlen({hay}) - {len(needle)})) END"


def _relevance_sql(needle: str, where: str, boost: str, extra: str = "", source: str = "entries", columns: str = "") -> str:
    (a, score_a), (b, score_b) = _exact_sql("name_fold", "name", "a", needle), _exact_sql("name_ufold", None, "b", needle)
    sql = f"SELECT * FROM {source} WHERE {where}"
    for x, y in zip(a, b):
        sql = f"SELECT *, {x}, {y} FROM ({sql})"
    sql = f"SELECT *, CAST(least(greatest({score_a}, {score_b}) + {_RECENT} + {boost}, 33554415) * 64 - least(depth, 16) AS BIGINT) AS score FROM ({sql})"
    order = f"score DESC, {BY_NAME}"
    return f"{ENTRIES_SQL}{extra} SELECT path, row_number() OVER (ORDER BY {order}) AS rank, score{columns} FROM ({sql}) ORDER BY {order}"


_BOOST = f"coalesce(CAST(trunc(30 * log2(1 + count * pow(2, -greatest(0, {NOW} - last_run) / 1209600))) AS INTEGER), 0)"
_search("relevance_exact", "report", None, sort="relevance", ascending=False, columns=("score",), limit=None)
ORACLE_SQL["relevance_exact"] = _relevance_sql("report", _name("report"), "0")
_search("relevance_inner", "er", None, sort="relevance", ascending=False, columns=("score",), limit=None)
ORACLE_SQL["relevance_inner"] = _relevance_sql("er", _name("er"), "0")
_search("relevance_frecency", "note", None, sort="relevance", ascending=False, columns=("score",), history=True, limit=None)
ORACLE_SQL["relevance_frecency"] = _relevance_sql("note", _name("note"), _BOOST, ", " + HISTORY_SQL, "(SELECT * FROM entries LEFT JOIN history USING (path))")



def _or_sql(needles: tuple[str, ...]) -> str:
    """Ranked matches of a group of alternatives: of each row the score of the first that matches."""
    sql, scores = f"SELECT * FROM entries WHERE {' OR '.join(_name(n) for n in needles)}", []
    for i, needle in enumerate(needles):
        (a, score_a), (b, score_b) = _exact_sql("name_fold", "name", f"a{i}_", needle), _exact_sql("name_ufold", None, f"b{i}_", needle)
        for x, y in zip(a, b):
            sql = f"SELECT *, {x}, {y} FROM ({sql})"
        scores.append(f"greatest({score_a}, {score_b})")
    sql = f"SELECT *, CAST((coalesce({', '.join(scores)}) + {_RECENT}) * 64 - least(depth, 16) AS BIGINT) AS score FROM ({sql})"
    return f"{ENTRIES_SQL} SELECT path, row_number() OVER (ORDER BY score DESC, {BY_NAME}) AS rank, score FROM ({sql}) ORDER BY score DESC, {BY_NAME}"


def _word_sql(word: str) -> str:
    """Ranked matches of a whole word, by its first occurrence as one."""
    inner = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"

    def score(c: str) -> str:
        alone = f"substr({c}, i, {len(word)}) = '{word}' AND (i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), '{inner}')) AND NOT regexp_matches(substr({c}, i + {len(word)}, 1), '{inner}')"
        at = f"list_min(list_filter(range(1, length({c}) + 1), lambda i: {alone}))"
        return f"(SELECT 1000 - least(strlen(substr({c}, 1, p - 1)), 900) + CASE WHEN p = 1 OR substr({c}, p - 1, 1) IN ('/', '_', '-', '.', ' ') THEN 80 ELSE 0 END FROM (SELECT {at} AS p) WHERE p IS NOT NULL)"

    sql = f"SELECT *, CAST((greatest({score('name_fold')}, {score('name_ufold')}) + {_RECENT}) * 64 - least(depth, 16) AS BIGINT) AS score FROM entries WHERE {_word(word)}"
    return f"{ENTRIES_SQL} SELECT path, row_number() OVER (ORDER BY score DESC, {BY_NAME}) AS rank, score FROM ({sql}) ORDER BY score DESC, {BY_NAME}"


_search("relevance_or", "report|note", None, sort="relevance", ascending=False, columns=("score",), limit=None)
ORACLE_SQL["relevance_or"] = _or_sql(("report", "note"))
_search("relevance_whole_word", "ww: report", None, sort="relevance", ascending=False, columns=("score",), limit=None)
ORACLE_SQL["relevance_whole_word"] = _word_sql("report")


def _fuzzy_ctes(needle: str) -> str:
    """Common table expressions that end with `f_<needle>` (path, score): the best alignment in SQL.

    Level by level of the needle's bytes: a cell of a level is a place of that byte, reached after a gap
    (which costs by its length) or right after the cell before (which may carry on a boundary's bonus).
    """
    out = []
    for tag, hay, cased in (("a", "name_fold", "name"), ("u", "name_ufold", "NULL")):
        p = f"{tag}_{needle}"
        out.append(
            f"""{p}_bytes AS (
  SELECT path, size, j, substr(h, 2 * j + 1, 2) AS byte,
    CASE WHEN j = 0 OR substr(h, 2 * j - 1, 2) IN ('2F', '5F', '2D', '2E', '20') OR (j < 64 AND substr(c, 2 * j + 1, 2) BETWEEN '41' AND '5A' AND (substr(c, 2 * j - 1, 2) BETWEEN '61' AND '7A' OR substr(c, 2 * j - 1, 2) BETWEEN '30' AND '39')) THEN 10 ELSE 0 END AS bonus
  FROM (SELECT path, strlen({hay}) AS size, hex(encode({hay})) AS h, coalesce(hex(encode({cased})), '') AS c, unnest(range(strlen({hay}))) AS j FROM entries WHERE {hay} IS NOT NULL))"""
        )
        for k, byte in enumerate(needle.encode()):
            if k == 0:
                out.append(f"{p}_0 AS (SELECT path, size, j, 16 + 2 * bonus AS v, j AS first, bonus AS run FROM {p}_bytes WHERE byte = '{byte:02X}')")
                continue
            out.append(
                f"""{p}_{k} AS (
  SELECT path, size, j, CASE WHEN near >= far THEN near ELSE far END AS v, CASE WHEN near >= far THEN near_first ELSE far_first END AS first, CASE WHEN near >= far THEN greatest(near_run, bonus) ELSE bonus END AS run
  FROM (SELECT b.path, b.size, b.j, b.bonus, max(l.v - 3 - (b.j - 1 - l.j)) + 16 + b.bonus AS far, arg_max(l.first, (l.v - 3 - (b.j - 1 - l.j)) * 4096 - l.j) AS far_first,
      max(CASE WHEN l.j = b.j - 1 THEN l.v + 16 + greatest(b.bonus, l.run, 4) END) AS near, max(CASE WHEN l.j = b.j - 1 THEN l.first END) AS near_first, max(CASE WHEN l.j = b.j - 1 THEN l.run END) AS near_run
    FROM {p}_bytes b JOIN {p}_{k - 1} l ON l.path = b.path AND l.j < b.j WHERE b.byte = '{byte:02X}' GROUP BY b.path, b.size, b.j, b.bonus))"""
            )
        out.append(f"{p} AS (SELECT path, greatest(1, max(v - first) + greatest(0, 40 - (any_value(size) - {len(needle)}))) AS score FROM {p}_{len(needle) - 1} GROUP BY path)")
    out.append(f"f_{needle} AS (SELECT path, max(score) AS score FROM (SELECT * FROM a_{needle} UNION ALL SELECT * FROM u_{needle}) GROUP BY path)")
    return ", " + ", ".join(out)


ORACLE_SQL["fuzzy_rank"] = (
    f"{ENTRIES_SQL}{_fuzzy_ctes('nt1')}{_fuzzy_ctes('swift')}, r AS (SELECT e.*, CAST((s.score + t.score + {_RECENT}) * 64 - least(depth, 16) AS BIGINT) AS score "
    f"FROM entries e JOIN f_nt1 s USING (path) JOIN f_swift t USING (path)) SELECT path, row_number() OVER (ORDER BY score DESC, {BY_NAME}) AS rank, score FROM r ORDER BY score DESC, {BY_NAME}"
)

_FRECENCY = f"count * pow(2, -greatest(0, {NOW} - last_run) / 1209600)"
_search("runcount_order", "report|note ext:pdf", None, sort="runcount", ascending=False, history=True, limit=None)
_search("runcount_files", "ext:md,zip", None, sort="runcount", ascending=False, history=True, limit=None)
_ORDER = f"(count IS NOT NULL) DESC, {_FRECENCY} DESC, {BY_NAME}"
ORACLE_SQL["runcount_files"] = f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM entries LEFT JOIN history USING (path) WHERE ext IN ('md', 'zip') ORDER BY {_ORDER}"
ORACLE_SQL["runcount_order"] = f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM entries LEFT JOIN history USING (path) WHERE ({_name('report')} OR {_name('note')}) AND ext = 'pdf' ORDER BY {_ORDER}"


def _over_entries(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    register(name, lambda spark, sf_dir: run(entries(spark, sf_dir)), None if sql is None else ENTRIES_SQL + sql)


# Tree
_over_entries("entries_columns", lambda e: e.select("path", "name_fold", "name_ufold", "path_ufold", "parent_path", "depth", "ext", "type_mask", "is_package", "is_hidden"), "SELECT path, name_fold, name_ufold, path_ufold, parent_path, depth, ext, type_mask, is_package, is_hidden FROM entries")
_over_entries("tree_ancestors", lambda e: e.select("path", F.explode(tree.ancestors(F.col("path"))).alias("ancestor")), "SELECT path, CASE WHEN n = 1 THEN '/' ELSE array_to_string(string_split(path, '/')[1:n], '/') END AS ancestor FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM entries WHERE path <> '/')")
_over_entries("folder_sizes", lambda e: e.where("is_dir").select("path", "subtree_size"), "SELECT path, subtree_size FROM entries WHERE is_dir")
_over_entries("subtree_size", lambda e: tree.subtree_size(e, "/apps"), "SELECT coalesce(sum(size), 0)::BIGINT AS subtree_size FROM entries WHERE starts_with(path, '/apps/') AND NOT is_dir")
_over_entries("selection_total", lambda e: tree.selection_total(e.where("depth <= 3")), "SELECT coalesce(sum(size) FILTER (NOT is_dir), 0)::BIGINT AS total FROM entries WHERE depth <= 3")
_over_entries("children_counts", tree.children, "SELECT parent_path, count(*) AS children FROM entries WHERE parent_path IS NOT NULL GROUP BY 1")
_over_entries("name_counts", lambda e: e.groupBy("name_fold").agg(F.count("*").alias("n")), "SELECT name_fold, count(*) AS n FROM entries GROUP BY 1")
_over_entries("crawl_stats", listings.crawl_stats, "SELECT count(*) FILTER (obj_type = 1) AS files, count(*) FILTER (obj_type = 2) AS folders, count(*) FILTER (obj_type = 5) AS links, count(*) FILTER ((flags & 1099511627776) <> 0) AS errors FROM entries")
_over_entries("match_total", lambda e: search(e, "report", now=NOW).matches.agg(F.count("*").alias("total")), f"SELECT count(*) AS total FROM entries WHERE {_name('report')}")
_over_entries("names_kinds", lambda e: e.select("path", kind(F.col("obj_type"), F.col("name")).alias("kind"), shown_extension(F.col("name")).alias("shown"), F.coalesce("parent_path", "path").alias("folder")).where("folder <> '/x'"), "SELECT path, CASE WHEN obj_type = 5 THEN 'Alias' WHEN is_dir AND shown IN ('app', 'bundle', 'appex', 'plugin', 'kext', 'mlmodelc', 'xcodeproj', 'playground', 'docset', 'photoslibrary', 'musiclibrary', 'tvlibrary', 'fcpbundle') THEN 'Bundle' WHEN is_dir THEN 'Folder' WHEN shown = '' THEN 'Document' ELSE upper(shown) || ' file' END AS kind, shown, coalesce(parent_path, path) AS folder FROM (SELECT *, lower(regexp_extract(name, '^.+\\.([^./ ]+)$', 1)) AS shown FROM entries)".replace("\\\\", "\\"))


def _spans(e: DataFrame) -> DataFrame:
    found = e.select("path", F.explode(highlight.highlight(F.col("name"), "report -x e ext:md")).alias("span"))
    return found.select("path", "span.start", "span.length")


_over_entries("highlight_spans", _spans, "SELECT DISTINCT path, CAST(i - 1 AS INTEGER) AS start, CAST(length(t) AS INTEGER) AS length FROM (SELECT path, name, t, unnest(range(1, length(name) + 1)) AS i FROM entries, (VALUES ('report'), ('e')) AS w(t)) WHERE lower(substr(name, i, length(t))) = t")
_BYTES = "list_transform(range(strlen({0})), lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::INTEGER)"
_BIT = "CASE WHEN b BETWEEN 65 AND 90 THEN b - 65 WHEN b BETWEEN 97 AND 122 THEN b - 97 WHEN b BETWEEN 48 AND 57 THEN b - 22 ELSE 36 + b % 28 END"
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END AS BIGINT)"
_over_entries(
    "name_masks",
    lambda e: e.select("path", fingerprint.mask_column(F.col("name")).alias("mask"), fingerprint.fnv_column(F.col("path")).alias("fnv")),
    f", m AS (SELECT path, sum(1::HUGEINT << bit) AS mask FROM (SELECT DISTINCT path, {_BIT} AS bit FROM (SELECT path, unnest({_BYTES.format('name')}) AS b FROM entries)) GROUP BY path), "
    f"f AS (SELECT path, list_reduce({_BYTES.format('path')}, lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT, {fingerprint.FNV_OFFSET}::HUGEINT) AS fnv FROM entries) "
    f"SELECT path, {_SIGNED.format('mask')} AS mask, {_SIGNED.format('fnv')} AS fnv FROM m JOIN f USING (path)",
)
_over_entries("mask_prefilter", lambda e: e.where(fingerprint.may_contain(fingerprint.mask_column(F.col("name_fold")), "report") & F.contains("name_fold", F.lit("report"))).select("path"), "SELECT path FROM entries WHERE contains(name_fold, 'report')")


def _fuzzy(e: DataFrame) -> DataFrame:
    score = scoring.fuzzy_score("rpt")
    return e.select("path", F.greatest(score(F.col("name_fold"), F.col("name")), score(F.col("name_ufold"), F.lit(None).cast("string"))).alias("score"))


_over_entries("fuzzy_scores", _fuzzy, f"{_fuzzy_ctes('rpt')} SELECT path, CAST(score AS INTEGER) AS score FROM entries LEFT JOIN f_rpt USING (path)")
_over_entries("row_counts", lambda e: diff.row_counts(live.unmount(e, "/corpus/src1")), "SELECT count(*) FILTER (NOT d) AS live, count(*) FILTER (d) AS deleted FROM (SELECT path = '/corpus/src1' OR starts_with(path, '/corpus/src1/') AS d FROM entries)")


def _paths_again(spark: SparkSession, picked: DataFrame) -> DataFrame:
    ids = picked.select(F.xxhash64("path").alias("id"), F.coalesce(F.xxhash64("parent_path"), F.lit(-1)).alias("p"), "name", "parent_path")
    nodes = ids.select("id", F.when(F.col("parent_path").isNull(), F.lit(-1).cast("long")).otherwise(F.col("p")).alias("parent"), "name")
    return tree.paths_from_parents(spark, nodes).select("path", F.col("depth").cast("int").alias("depth"))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all entries found again by recursion over parent links."""
    return _paths_again(spark, entries(spark, sf_dir))


register("tree_paths", tree_paths, ENTRIES_SQL + "SELECT path, depth FROM entries")


def ingest_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that stays on one device: here a file's device is its size modulo three."""
    rows = tables.listing(spark, sf_dir).withColumn("device", F.col("size") % 3)
    return select_listing(rows, device=1).select("path")


register("ingest_device", ingest_device, ENTRIES_SQL + "SELECT path FROM listing WHERE size % 3 = 1")


def ingest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl takes with excluded folders, name patterns to leave out and a list of those to take."""
    rows = select_listing(tables.listing(spark, sf_dir), exclude=["/web", "/corpus/src0"], mounts=["/apps"], exclude_files="*.PDF;note_1?.*", include_files="*.p*;note*;*.jpg")
    return rows.select("path")


register(
    "ingest_rules", ingest_rules,
    ENTRIES_SQL + "SELECT path FROM (SELECT *, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM listing) WHERE NOT starts_with(path, '/web/') AND NOT starts_with(path, '/corpus/src0/') AND NOT starts_with(path, '/apps/') AND (obj_type = 2 OR (NOT (f LIKE '%.pdf' OR f LIKE 'note|_1_.%' ESCAPE '|') AND (f LIKE '%.p%' OR f LIKE 'note%' OR f LIKE '%.jpg')))",
)


def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of given paths: those of the run history."""
    return tree.resolve(entries(spark, sf_dir), tables.history(spark, sf_dir)).select("path", "size")


register("resolve_paths", resolve_paths, f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, size FROM entries WHERE path IN (SELECT path FROM history)")


# Run history
def frecency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.scored(tables.history(spark, sf_dir), NOW).select("path", "count", F.round("frecency", 6).alias("frecency"))


def history_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = tables.history(spark, sf_dir)
    opens = before.where("count > 5").select("path", (F.col("last_run") + 60).alias("at"))
    return history.record(before, opens).select("path", "count", F.round("last_run", 3).alias("last_run"))


def history_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prune(tables.history(spark, sf_dir), NOW, cap=100).select("path", "count")


register("frecency_scores", frecency_scores, f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, count, round({_FRECENCY}, 6) AS frecency FROM history")
register("history_record", history_record, f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, CASE WHEN count > 5 THEN count + 1 ELSE count END AS count, round(CASE WHEN count > 5 THEN last_run + 60 ELSE last_run END, 3) AS last_run FROM history")
register("history_prune", history_prune, f"{ENTRIES_SQL}, {HISTORY_SQL} SELECT path, count FROM history ORDER BY {_FRECENCY} DESC, path LIMIT 100")


def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent searches, as if every event were a search for its type, in mixed case."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    query = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return history.recent_searches(events.select(query.alias("query"), F.col("event_id").alias("at")))


register("recent_searches", recent_searches, 'SELECT query, seq AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY seq DESC, query) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS query, event_id AS seq FROM events)) WHERE n = 1 ORDER BY seq DESC, query LIMIT 15')


# Differences, generations, exports
_K = "TRY_CAST(regexp_extract(name, '_([0-9]+)[.]', 1) AS BIGINT)"


def changed_listing(rows: DataFrame) -> DataFrame:
    """The listing with, of every ten documents, one gone, one larger, one turned into a folder and one new beside it."""
    rows = rows.select("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags").where("path like '/corpus/%'")
    k = F.regexp_extract("name", "_([0-9]+)[.]", 1).try_cast("long") % 10
    new = rows.where(k == 3).withColumns({"path": F.concat("path", F.lit(".new")), "name": F.concat("name", F.lit(".new"))})
    kept = rows.where(k != 0).withColumns({"size": F.when(k == 1, F.col("size") + 1).when(k == 2, 0).otherwise(F.col("size")), "obj_type": F.when(k == 2, 2).otherwise(F.col("obj_type"))})
    return kept.unionByName(new)


_CHANGED = f"""
, old AS (SELECT *, {_K} % 10 AS k10 FROM listing WHERE path LIKE '/corpus/%'),
changes AS (
  SELECT path, CASE k10 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 2 THEN 'replaced' ELSE 'same' END AS change, size AS old_size,
    CASE k10 WHEN 0 THEN NULL WHEN 1 THEN size + 1 WHEN 2 THEN 0 ELSE size END AS size FROM old
  UNION ALL SELECT path || '.new', 'added', NULL, size FROM old WHERE k10 = 3
)
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    folders = e.where("is_dir and path like '/corpus/%/%'").select("path")
    return diff.folder_diff(e, changed_listing(tables.listing(spark, sf_dir)), folders)


register("dir_diff", lambda s, d: _diff(s, d).select("path", "change", "old_size", "size"), f"{ENTRIES_SQL}{_CHANGED} SELECT path, change, old_size, size FROM changes")
register("diff_counters", lambda s, d: diff.counters(_diff(s, d)), f"{ENTRIES_SQL}{_CHANGED} SELECT count(*) FILTER (change IN ('added', 'replaced')) AS added, count(*) FILTER (change IN ('removed', 'replaced')) AS removed, count(*) FILTER (change = 'changed') AS changed FROM changes")
register(
    "change_log", lambda s, d: diff.change_log(_diff(s, d), 7),
    f"{ENTRIES_SQL}{_CHANGED} SELECT 7::BIGINT AS batch, path, 1 AS kind, (-old_size)::BIGINT AS size_delta FROM changes WHERE change IN ('removed', 'replaced') UNION ALL SELECT 7, path, 0, CASE WHEN change = 'replaced' THEN 0 ELSE size END FROM changes WHERE change IN ('added', 'replaced') UNION ALL SELECT 7, path, 2, size - old_size FROM changes WHERE change = 'changed'",
)
_AFTER = f"{ENTRIES_SQL}{_CHANGED}, after AS (SELECT path, size, is_dir FROM entries WHERE path NOT IN (SELECT path FROM changes) UNION ALL SELECT path, size, change = 'replaced' FROM changes WHERE change <> 'removed')"
register("diff_applied", lambda s, d: tree.live(diff.apply(entries(s, d), _diff(s, d))).select("path", "size", "is_dir"), f"{_AFTER} SELECT path, size, is_dir FROM after")


def totals_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder totals carried forward by the change log alone."""
    log = diff.change_log(_diff(spark, sf_dir), 1)
    stored = entries(spark, sf_dir).where("subtree_size <> 0").select("path", "subtree_size")
    return diff.totals_after(stored, log)


register("totals_incremental", totals_incremental, f"{_AFTER} SELECT CASE WHEN n = 1 THEN '/' ELSE array_to_string(parts[1:n], '/') END AS path, sum(size)::BIGINT AS subtree_size FROM (SELECT size, parts, unnest(range(1, len(parts))) AS n FROM (SELECT size, string_split(path, '/') AS parts FROM after WHERE NOT is_dir)) GROUP BY 1 HAVING sum(size) <> 0")


def tombstone_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("/corpus/src1",), ("/catalog",)], "path string")
    return diff.tombstone(entries(spark, sf_dir), gone).select("path", "deleted")


_GONE = "(path = '/corpus/src1' OR starts_with(path, '/corpus/src1/') OR path = '/catalog' OR starts_with(path, '/catalog/'))"
register("tombstone_cascade", tombstone_cascade, f"{ENTRIES_SQL} SELECT path, {_GONE} AS deleted FROM entries")
register("compaction", lambda s, d: diff.compact(live.unmount(entries(s, d), "/corpus/src1")).select("path"), f"{ENTRIES_SQL} SELECT path FROM entries WHERE NOT (path = '/corpus/src1' OR starts_with(path, '/corpus/src1/'))")


def _scratch(spark: SparkSession) -> str:
    """A folder for files that a query writes and reads back."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark) + "/snapshot"
    snapshot.save(entries(spark, sf_dir), folder)
    return snapshot.load(spark, folder).select("path", "size", "mtime_ns", "subtree_size", "is_dupe")


register("snapshot_roundtrip", snapshot_roundtrip, ENTRIES_SQL + "SELECT path, size, mtime_ns, subtree_size, is_dupe FROM entries")


def live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live paths after a stream of events has been followed: the same changes as in `dir_diff`."""
    folder = _scratch(spark)
    e = entries(spark, sf_dir)
    snapshot.save(e, f"{folder}/snapshot")
    paths = e.where("is_dir and path like '/corpus/%/%'").select("path")
    events = paths.select(F.pmod(F.xxhash64("path"), F.lit(1_000_000)).alias("seq"), "path", F.lit(False).alias("must_scan"))
    events.coalesce(1).write.parquet(f"{folder}/events")
    folders = e.where("is_dir and path like '/corpus/%'").select("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags")
    now = keep(changed_listing(tables.listing(spark, sf_dir)).unionByName(folders))
    stream = spark.readStream.schema(live.EVENTS).parquet(f"{folder}/events")
    live.follow(spark, stream, f"{folder}/snapshot", lambda folders: now, f"{folder}/checkpoint").awaitTermination()
    return tree.live(snapshot.load(spark, f"{folder}/snapshot")).select("path", "size")


register("live_stream", live_stream, f"{_AFTER} SELECT path, size FROM after")
_DATE = "CASE WHEN {0} = 0 THEN '' ELSE strftime(make_timestamp({0} // 1000), '%Y-%m-%d %H:%M:%S') END"
_over_entries("csv_rows", lambda e: export.csv_rows(search(e, "e ext:md,jpg,bundle", now=NOW, limit=None).rows), f"SELECT name AS \"Name\", path AS \"Path\", CASE WHEN is_dir THEN '' ELSE size::VARCHAR END AS \"Size\", {_DATE.format('mtime_ns')} AS \"Date Modified\", {_DATE.format('crtime_ns')} AS \"Date Created\" FROM entries WHERE {_name('e')} AND ext IN ('md', 'jpg', 'bundle')")
_FIELD = "CASE WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_over_entries("csv_lines", export.csv_lines, f"SELECT {_FIELD.format('name')} || ',' || {_FIELD.format('path')} || ',' || CASE WHEN is_dir THEN '' ELSE size::VARCHAR END || ',' || {_DATE.format('mtime_ns')} || ',' || {_DATE.format('crtime_ns')} AS line FROM entries")


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that narrows an earlier one, run over the earlier one's matches."""
    e = entries(spark, sf_dir)
    first = search(e, "rep ext:pdf,md", now=NOW)
    return refine(e, first, "report_1 ext:pdf", now=NOW, limit=None).ranked().select("path", "rank")


register("refined", refined, f"{ENTRIES_SQL} SELECT path, row_number() OVER (ORDER BY {BY_NAME}) AS rank FROM entries WHERE {_name('report|_1').replace('|', '')} AND ext = 'pdf' ORDER BY {BY_NAME}")


def request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a response to a request."""
    engine = Engine(entries(spark, sf_dir))
    answer = engine.handle({"v": 1, "q": "report ext:pdf", "sort": "size", "limit": 20, "fields": ["path", "size"]}, now=NOW)
    return spark.createDataFrame([(r["path"], r["name"], r["size"], r["isDir"], answer["total"]) for r in answer["results"]], "path string, name string, size long, isDir boolean, total long")


register("request_response", request_response, f"{ENTRIES_SQL}, m AS (SELECT * FROM entries WHERE {_name('report')} AND ext = 'pdf') SELECT path, name, size, is_dir AS \"isDir\", (SELECT count(*) FROM m) AS total FROM m ORDER BY size DESC, depth DESC, path DESC LIMIT 20")


def root_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after one root has been crawled anew."""
    e = entries(spark, sf_dir)
    return live.rescan(e, "/corpus/src1", changed_listing(tables.listing(spark, sf_dir))).select("path", "size")


register(
    "root_rescan", root_rescan,
    f"{ENTRIES_SQL}{_CHANGED}, found AS (SELECT path, size, change = 'replaced' AS is_dir FROM changes WHERE change <> 'removed' AND starts_with(path, '/corpus/src1/')), "
    "alive AS (SELECT path, size FROM entries WHERE depth > 0 AND NOT (path = '/corpus/src1' OR starts_with(path, '/corpus/src1/')) UNION ALL SELECT path, size FROM found), "
    "up AS (SELECT DISTINCT CASE WHEN n = 1 THEN '/' ELSE array_to_string(string_split(path, '/')[1:n], '/') END AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM alive)) "
    "SELECT path, size FROM alive UNION ALL SELECT path, 0 FROM up WHERE path NOT IN (SELECT path FROM alive)",
)


def root_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots to crawl: local volumes and custom folders, and how they differ from those that are indexed."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    volume = F.concat(F.lit("/"), "n_name")
    volumes = nations.select(volume.alias("path"), F.when(F.col("n_regionkey") == 0, "network").when(F.col("n_regionkey") == 1, "system").otherwise("local").alias("kind"))
    roots = listings.choose_roots(volumes, nations.where("n_nationkey % 2 = 0").select(volume.alias("path")))
    return listings.root_changes(roots, nations.where("n_regionkey >= 3 or n_nationkey = 1").select(volume.alias("path")))


register("root_discovery", root_discovery, "WITH r AS (SELECT '/' || n_name AS path FROM nation WHERE n_regionkey > 1 OR n_nationkey % 2 = 0), i AS (SELECT '/' || n_name AS path FROM nation WHERE n_regionkey >= 3 OR n_nationkey = 1) SELECT path, 'mount' AS change FROM r WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'unmount' FROM i WHERE path NOT IN (SELECT path FROM r)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a ranked search with filters, run history and folder totals."""
    found = search(entries(spark, sf_dir), "report ext:pdf,md,txt size:>1kb dm:month", sort="relevance", ascending=False, now=NOW, history=tables.history(spark, sf_dir), limit=None)
    return found.ranked().select("rank", "score", "path", "name", "size")


_MONTH = f"mtime_ns >= {_TODAY - 30 * _DAY_NS} AND mtime_ns < {_TODAY + _DAY_NS}"
register(
    "flagship", flagship,
    _relevance_sql("report", f"{_name('report')} AND ext IN ('pdf', 'md', 'txt') AND size > 1024 AND {_MONTH}", _BOOST, ", " + HISTORY_SQL, "(SELECT * FROM entries LEFT JOIN history USING (path))", ", name, size"),
)
