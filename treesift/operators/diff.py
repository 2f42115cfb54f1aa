"""What changed between a table of entries and a fresh listing, and the table after it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..sources.keep import keep, small
from ..sources.listing import FOLDER
from .ingest import enrich, sums_above, under
from .tree import ancestors, live, parent_of

ADDED, REMOVED, CHANGED, REPLACED, SAME = "added", "removed", "changed", "replaced", "same"
#: Kinds of records of the change log.
APPEND, TOMBSTONE, ATTRIBUTE = 0, 1, 2
_BASE = ("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags")

# When a table is rewritten without its deleted rows.
COMPACT_ROWS, COMPACT_SHARE, COMPACT_HARD, COMPACT_SECONDS = 50_000, (1, 4), (2, 5), 600

#: Removed folders that are looked for by their prefixes; more are found by a join.
FEW_FOLDERS = 64


def folder_diff(entries: DataFrame, listing: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, change, old_size, size, ...): the children of the given folders (path), before and now.

    A full outer join by path; what turned from a folder into something else or back is `replaced`.
    """
    dirty = folders.select(F.col("path").alias("parent_path")).distinct()
    old = live(entries).join(dirty, "parent_path", "left_semi").select("path", *(F.col(c).alias(f"old_{c}") for c in _BASE[2:]))
    new = listing.withColumn("parent_path", parent_of(F.col("path"))).join(dirty, "parent_path", "left_semi").select(*_BASE)
    both = old.join(new.withColumn("here", F.lit(True)), "path", "full_outer")
    was, now = F.col("old_obj_type").isNotNull(), F.coalesce("here", F.lit(False))
    flipped = (F.col("old_obj_type") == FOLDER) != (F.col("obj_type") == FOLDER)
    altered = F.lit(False)
    for c in ("size", "mtime_ns", "crtime_ns", "obj_type", "flags"):
        altered = altered | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    change = F.when(~was, ADDED).when(~now, REMOVED).when(flipped, REPLACED).when(altered, CHANGED).otherwise(SAME)
    return both.withColumn("change", change).drop("here")


def counters(diff: DataFrame) -> DataFrame:
    """One row: entries added, removed and changed; a replaced one is both added and removed."""
    c = F.col("change")
    return diff.agg(F.count_if(c.isin(ADDED, REPLACED)).alias("added"), F.count_if(c.isin(REMOVED, REPLACED)).alias("removed"), F.count_if(c == CHANGED).alias("changed"))


def below(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The live entries that are, or are anywhere below, one of the given paths (path).

    A few paths are prefixes, which scans prune by; with many, each entry asks for its own path and its
    ancestors', an equi-join of bounded fan-out, so nothing is compared with every removed folder.
    """
    found = gone.select("path").distinct().limit(FEW_FOLDERS + 1).collect()  # at most so many paths
    alive = live(entries)
    if not found:
        return alive.limit(0)
    if len(found) <= FEW_FOLDERS:
        return alive.where(reduce(or_, (under(F.col("path"), r.path) for r in found)))
    chain = alive.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("at"))
    dead = chain.join(gone.select(F.col("path").alias("at")).distinct(), "at", "left_semi").select("path").distinct()
    return alive.join(dead, "path", "left_semi")


def tombstone(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The entries with the given paths, and all below them, marked as deleted."""
    dead = below(entries, gone).select("path").withColumn("dead", F.lit(True))
    return entries.join(dead, "path", "left").withColumn("deleted", F.col("deleted") | F.coalesce("dead", F.lit(False))).drop("dead")


def removed(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The diff that removes the entries of the given paths (path)."""
    rows = live(entries).join(gone.select("path").distinct(), "path", "left_semi")
    old = [F.col(c).alias(f"old_{c}") for c in _BASE[2:]]
    new = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in _BASE[1:]]
    return rows.select("path", *old, *new, F.lit(REMOVED).alias("change"))


def delta(entries: DataFrame, diff: DataFrame) -> DataFrame:
    """New versions of all rows that a diff changes: those that go (deleted), come and change, and the folders
    and names whose totals, emptiness or recurrence change with them.

    Nothing is computed anew for the whole table: sums are carried along the ancestors of what has
    changed, and names and folders are counted only where a row of theirs goes or comes.  Every join has
    the rows of the diff, their ancestors or their names on its other side, broadcast while they are few.
    """
    columns = entries.columns
    diff = keep(diff.where(F.col("change") != SAME))
    changed, n = diff.where(F.col("change") == CHANGED), diff.count()
    leaving = diff.where(F.col("change").isin(REMOVED, REPLACED)).select("path", (F.col("old_obj_type") == FOLDER).alias("folder"))
    alive = live(entries)
    trees = below(entries, leaving.where("folder"))
    single = alive.join(small(leaving.where("not folder").select("path"), n), "path", "left_semi")
    dead = keep(trees.unionByName(single).dropDuplicates(["path"]))
    added = keep(enrich(diff.where(F.col("change").isin(ADDED, REPLACED)).select(*_BASE)))

    def moved(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("path", "name_fold", "parent_path", F.when(F.col("is_dir"), 0).otherwise(sign * F.col("size")).alias("bytes"), F.lit(sign).alias("sign"))

    moves = keep(moved(dead, -1).unionByName(moved(added, 1)))
    n = max(n, moves.count())  # no table of paths, names or folders below has more rows, but for that of ancestors
    resized = changed.where(F.col("obj_type") != FOLDER).join(small(dead.select("path"), n), "path", "left_anti").select("path", (F.col("size") - F.col("old_size")).alias("bytes"))
    up = sums_above(moves.select("path", "bytes").unionByName(resized).where("bytes <> 0")).where("subtree_size <> 0")
    up = keep(up.select("path", F.col("subtree_size").alias("more")))

    def counted(key: str) -> DataFrame:
        """(key, n): live rows after the change, of the names or folders of which one goes or comes."""
        net = keep(moves.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("sign").alias("n")))
        had = alive.join(small(net.select(key), n), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        return keep(net.unionByName(had).groupBy(key).agg(F.sum("n").alias("n")))

    names = counted("name_fold").select("name_fold", (F.col("n") > 1).alias("dupe_now"))
    parents = counted("parent_path").select(F.col("parent_path").alias("path"), (F.col("n") == 0).alias("empty_now"))

    attributes = [c for c in _BASE[2:]]
    touched = keep(changed.select("path").unionByName(up.select("path")).unionByName(parents.select("path")).distinct())
    by_path = alive.join(small(touched), "path", "left_semi")
    by_name = alive.join(small(names, n), "name_fold").where("is_dupe <> dupe_now").drop("dupe_now").join(small(touched), "path", "left_anti")
    new = keep(by_path.select(*columns).unionByName(by_name.select(*columns)).join(small(dead.select("path"), n), "path", "left_anti"))
    new = new.join(small(changed.select("path", *(F.col(c).alias(f"new_{c}") for c in attributes)), n), "path", "left")
    there = F.col("new_obj_type").isNotNull()
    new = new.withColumns({c: F.when(there, F.col(f"new_{c}")).otherwise(F.col(c)) for c in attributes})
    new = new.withColumn("is_hidden", (F.col("flags").bitwiseAND(F.lit(0x8000)) != 0) | F.col("name").startswith("."))

    none = {"subtree_size": F.lit(None).cast("long"), "is_dupe": F.lit(False), "is_empty_dir": F.col("is_dir")}
    after = new.select(*columns).unionByName(added.withColumns(none).select(*columns))
    after = after.join(small(up), "path", "left").join(small(parents, n), "path", "left").join(small(names, n), "name_fold", "left")
    after = after.withColumns(
        {
            "subtree_size": F.when(F.col("is_dir"), F.coalesce("subtree_size", F.lit(0)) + F.coalesce("more", F.lit(0))),
            "is_dupe": F.coalesce("dupe_now", "is_dupe"),
            "is_empty_dir": F.col("is_dir") & F.coalesce("empty_now", "is_empty_dir"),
        }
    )
    # a path that goes as one thing and comes as another is the new one
    gone = dead.withColumn("deleted", F.lit(True)).join(small(added.select("path"), n), "path", "left_anti")
    return after.select(*columns).unionByName(gone.select(*columns))


def overlay(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """The entries with rows replaced by their new versions (kept, at most one for each path)."""
    return entries.join(small(versions.select("path")), "path", "left_anti").select(*entries.columns).unionByName(versions.select(*entries.columns))


def apply(entries: DataFrame, diff: DataFrame) -> DataFrame:
    """The table after the changes: a rename is a deletion and an addition, attributes change in place."""
    return overlay(entries, keep(delta(entries, diff)))


def change_log(diff: DataFrame, batch: int) -> DataFrame:
    """(batch, path, kind, size_delta): records of a diff; a change of flags alone leaves none."""
    c = F.col("change")
    size, old = (F.when(F.col(t) == FOLDER, 0).otherwise(F.col(s)) for t, s in (("obj_type", "size"), ("old_obj_type", "old_size")))
    attribute = (c == CHANGED) & ~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ns").eqNullSafe(F.col("old_mtime_ns")) & F.col("crtime_ns").eqNullSafe(F.col("old_crtime_ns")))
    records = F.filter(
        F.array(
            F.when(c.isin(REMOVED, REPLACED), F.struct(F.lit(TOMBSTONE).alias("kind"), (-old).cast("long").alias("size_delta"))),
            F.when(c.isin(ADDED, REPLACED), F.struct(F.lit(APPEND).alias("kind"), size.cast("long").alias("size_delta"))),
            F.when(attribute, F.struct(F.lit(ATTRIBUTE).alias("kind"), (size - old).cast("long").alias("size_delta"))),
        ),
        lambda r: r.isNotNull(),
    )
    return diff.select(F.lit(batch).cast("long").alias("batch"), "path", F.explode(records).alias("r")).select("batch", "path", "r.kind", "r.size_delta")


def totals_after(totals: DataFrame, log: DataFrame) -> DataFrame:
    """Folder totals (path, subtree_size) with the size deltas of a change log added on the way up."""
    deltas = log.where("size_delta <> 0").select(F.explode(ancestors(F.col("path"))).alias("path"), F.col("size_delta").alias("subtree_size"))
    return totals.select("path", "subtree_size").unionByName(deltas).groupBy("path").agg(F.sum("subtree_size").alias("subtree_size")).where("subtree_size <> 0")


def should_compact(total: int, deleted: int, now: float, last: float) -> bool:
    """Whether a table with so many deleted rows is rewritten; integers only, so the bounds are exact."""
    def over(share: tuple[int, int]) -> bool:
        return deleted * share[1] > total * share[0]

    return total > COMPACT_ROWS and (over(COMPACT_HARD) or over(COMPACT_SHARE) and now - last >= COMPACT_SECONDS)


def compact(entries: DataFrame) -> DataFrame:
    return live(entries)


def row_counts(entries: DataFrame) -> DataFrame:
    """One row: live and deleted entries."""
    return entries.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("deleted"))
