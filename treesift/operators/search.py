"""Search: filter, rank, order and cap `entries`.

A search is one lazy plan: conditions on stored columns, post-filters as joins, and
`orderBy(...).limit(n)`, which Spark runs as a top-n on each partition before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Row, Window, functions as F

from ..functions import scoring
from ..functions.text import ascii_fold, ascii_lower, nfc, tag_name
from ..plans.compiler import any_of, filters, match_score, narrows
from ..plans.parser import parse
from ..plans.query import EXACT, NAME, PATH, REGEX, ParsedQuery, SearchOptions
from ..sources.keep import keep_columns
from .history import scored
from .ingest import under

LIMIT = 100_000
DATALESS = 0x4000_0000


@dataclass
class SearchResult:
    """All matches, their order, and the first `limit` of them (None: all)."""

    matches: DataFrame
    order: list[Column]
    limit: int | None
    parsed: ParsedQuery | None = None
    content_candidates: DataFrame | None = None
    content_too_large: DataFrame | None = None
    options: SearchOptions = SearchOptions()

    @property
    def rows(self) -> DataFrame:
        ordered = self.matches.orderBy(*self.order)
        return ordered if self.limit is None else ordered.limit(self.limit)

    def ranked(self) -> DataFrame:
        """The rows with their place (one task numbers at most `limit` rows; without a limit each task those of its range)."""
        if self.limit is None:
            return numbered(self.rows)
        return self.rows.withColumn("rank", F.row_number().over(Window.orderBy(*self.order)).cast("long"))

    def total(self) -> int:
        return self.matches.count()

    def top(self, *columns) -> tuple[int, list[Row]]:
        """(number of all matches, the first `limit` rows), in one pass over the matches."""
        seen = Observation()
        counted = self.matches.observe(seen, F.count(F.lit(1)).alias("total"))
        rows = counted.orderBy(*self.order)
        rows = (rows if self.limit is None else rows.limit(self.limit)).select(*columns).collect()
        return seen.get["total"], rows

    def truncated(self) -> bool:
        return self.limit is not None and self.total() > self.limit

    def content_incomplete(self) -> bool:
        """Whether there were more files than the budget of a `content:` search."""
        return self.content_candidates is not None and self.content_candidates.count() > self.options.content_budget

    def content_skipped_large(self) -> int:
        """Files that a `content:` search has left out for their size."""
        return self.content_too_large.count() if self.content_too_large is not None else 0


def numbered(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their place as `rank`: that within a task's range, after those of the ranges before."""
    place, task, before = F.col("_place"), "_task", "_before"
    rows = keep_columns(ordered.withColumn("_place", F.monotonically_increasing_id())).withColumn(task, F.shiftright(place, 33))
    sizes = rows.groupBy(task).agg(F.count("*").alias("n"))  # a row for each task
    earlier = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(task, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    rank = F.col(before) + place.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), task).withColumn("rank", rank.cast("long")).drop("_place", task, before).orderBy("rank")


def acts_as_dir() -> Column:
    return F.col("is_dir") & ~F.col("is_package")


def entry_order() -> list[str]:
    """Insertion order, which breaks ties: parents before children."""
    return ["depth", "path"]


def scan_order(sort: str, ascending: bool, options: SearchOptions) -> list[Column]:
    """The order of a sort that does not depend on the query; descending is its exact reverse."""
    size = F.when(F.col("is_dir"), F.col("subtree_size")).otherwise(F.col("size")) if options.folder_sizes else F.col("size")
    key = {"name": F.col("name_fold"), "path": F.col("path_fold"), "size": size, "modified": F.col("mtime_ns"), "created": F.col("crtime_ns")}
    columns = [key.get(sort, F.col("name_fold")), *(F.col(c) for c in entry_order())]
    return [c.asc() if ascending else c.desc() for c in columns]


def result_order(sort: str, ascending: bool, options: SearchOptions, ranked: bool) -> list[Column]:
    by_name = [F.col("name_fold").asc(), *(F.col(c).asc() for c in entry_order())]
    if sort == "relevance" and ranked:
        order = [F.col("score").asc() if ascending else F.col("score").desc(), *by_name]
    elif sort == "runcount":
        tracked = F.col("frecency").isNotNull()
        order = [tracked.desc(), F.col("frecency").asc() if ascending else F.col("frecency").desc(), *by_name]
    else:
        order = scan_order(sort, ascending, options)
    return [acts_as_dir().desc(), *order] if options.folders_first else order


def valid_regex(entries: DataFrame, pattern: str) -> bool:
    jvm = entries.sparkSession._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def _with_contents(found: DataFrame, contents: DataFrame, needle: str, case_sensitive: bool, order: list[Column], options: SearchOptions) -> tuple[DataFrame, DataFrame]:
    """Matches whose text has the needle, of the first files in scan order; and the files considered."""
    files = found.where(~F.col("is_dir") & (F.col("flags").bitwiseAND(F.lit(DATALESS)) == 0) & (F.col("size") <= options.content_max_bytes))
    text = F.col("content") if case_sensitive else ascii_fold(F.col("content"))
    hits = contents.where(F.contains(text, F.lit(needle if case_sensitive else ascii_lower(needle)))).select("path")
    return files.orderBy(*order).limit(options.content_budget).join(hits, "path", "left_semi"), files


def _with_tags(found: DataFrame, tags: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Matches that have, for every group, a tag that contains one of its texts."""
    def wanted(group: list[str]) -> Column:
        return F.exists("names", lambda t: any_of([F.contains(t, F.lit(w)) for w in group]))

    named = tags.select("path", F.transform("tags", tag_name).alias("names"))
    hits = named.where(reduce(and_, (wanted(g) for g in groups))).select("path")
    return found.join(hits, "path", "left_semi")


def search(
    entries: DataFrame,
    query: str,
    mode: str = EXACT,
    scope: str = NAME,
    sort: str = "name",
    ascending: bool = True,
    limit: int | None = LIMIT,
    now: float = 0.0,
    scope_root: str | None = None,
    options: SearchOptions = SearchOptions(),
    history: DataFrame | None = None,
    contents: DataFrame | None = None,
    tags: DataFrame | None = None,
    within: DataFrame | None = None,
) -> SearchResult:
    """The entries that match, in order: the first `limit`, or all with None.

    `history` (path, count, last_run), `contents` (path, content) and `tags` (path, tags) are read only
    by queries that ask for them.  `within` replaces the rows searched (see `refine`).  A scope that is
    no entry has no entries below it, so it finds nothing.
    """
    found = (entries if within is None else within).where("not deleted")
    parsed = None
    if mode == REGEX and query.strip():
        pattern = "(?iu)" + nfc(query)
        if not valid_regex(entries, pattern):
            found = found.limit(0)
        else:
            conditions = [F.rlike("path" if scope == PATH else "name", F.lit(pattern))]
            conditions += [under(F.col("path"), scope_root)] if scope_root else []
            found = found.where(reduce(and_, conditions))
    else:
        parsed = parse("" if mode == REGEX else query, PATH if scope == PATH else NAME, now, options.zone)
        conditions = filters(parsed, EXACT if mode == REGEX else mode, options, scope_root)
        if conditions:
            found = found.where(reduce(and_, conditions))
    ranked = parsed is not None and not (parsed.is_empty and not scope_root)

    considered = too_large = None
    if parsed is not None and parsed.tags:
        if tags is None:
            raise ValueError("a query with tag: needs the tags table")
        found = _with_tags(found, tags, parsed.tags)
    if parsed is not None and parsed.content is not None:
        if contents is None:
            raise ValueError("a query with content: needs the contents table")
        too_large = found.where(~F.col("is_dir") & (F.col("size") > options.content_max_bytes))
        found, considered = _with_contents(found, contents, parsed.content, parsed.case_sensitive, scan_order(sort, ascending, options), options)
    if options.hide_hidden:
        found = found.where("not is_hidden")
    if sort == "runcount" or sort == "relevance" and ranked:
        if history is not None:
            found = found.join(scored(history, now).select("path", "frecency"), "path", "left")
        else:
            found = found.withColumn("frecency", F.lit(None).cast("double"))
    if sort == "relevance" and ranked:
        total = match_score(parsed, mode, options) + scoring.frecency_boost(F.col("frecency")) + scoring.recency(F.col("mtime_ns"), now)
        found = found.withColumn("score", scoring.final_score(total, F.col("depth")).cast("long"))
    return SearchResult(found, result_order(sort, ascending, options, ranked), limit, parsed, considered, too_large, options)


def refine(entries: DataFrame, previous: SearchResult, query: str, **arguments) -> SearchResult:
    """The search, over the previous result's matches where the new query surely has no others.

    The previous search must have been an exact one with the same scope and options.
    """
    new = parse(query, arguments.get("scope", NAME), arguments.get("now", 0.0), arguments.get("options", SearchOptions()).zone)
    reuse = arguments.get("mode", EXACT) == EXACT and previous.parsed is not None and narrows(new, previous.parsed)
    drop = [c for c in ("frecency", "score") if c in previous.matches.columns]
    return search(entries, query, within=previous.matches.drop(*drop) if reuse else None, **arguments)
