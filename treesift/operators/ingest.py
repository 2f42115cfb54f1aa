"""From a file listing to the `entries` table that queries read.

An entry is identified by its path.  Insertion order, which breaks all ties, is (depth, path): a parent
always precedes its children, and no global numbering (with its single task) is needed.

Everything that depends on an entry alone or on its path is computed here, once, so that queries are
plain predicates over stored columns: folds, extension, category bits, depth, ancestors' paths, totals
of folders, and whether a name recurs or a folder is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..sources.keep import keep, keep_columns, small
from ..sources.listing import FILE, FOLDER, ROOT
from .tree import ancestors, depth_of, parent_of, repeated_names


def under(path: Column, folder: str) -> Column:
    """Whether a path is the folder or below it."""
    return F.lit(True) if folder == ROOT else (path == folder) | path.startswith(folder + "/")


def excluded(path: Column, folders: list[str]) -> Column:
    out = F.lit(False)
    for folder in folders:
        out = out | under(path, folder.rstrip("/") or ROOT)
    return out


def glob_like(pattern: str) -> str:
    """A glob (`*` any run, `?` one character) as a LIKE pattern with `|` as its escape."""
    escaped = "".join("|" + c if c in "%_|" else c for c in pattern)
    return escaped.replace("*", "%").replace("?", "_")


def matches_any(fold: Column, globs: str) -> Column:
    """Whether a folded name matches one of the patterns `a;b;c`."""
    out = F.lit(False)
    for pattern in filter(None, (p.strip() for p in globs.split(";"))):
        out = out | F.like(fold, F.lit(glob_like(text.search_fold(pattern))), F.lit("|"))
    return out


def select_listing(listing: DataFrame, exclude: list[str] = (), mounts: list[str] = (), exclude_files: str = "", include_files: str = "", device: int | None = None) -> DataFrame:
    """The rows of a crawl that are taken: outside excluded folders and other roots, on the same device,
    and, files alone, by name patterns."""
    path, fold = F.col("path"), text.ascii_fold(F.col("name"))
    rows = listing.where(~excluded(path, [*exclude, *mounts]))
    if device is not None:
        rows = rows.where(F.col("device") == device)
    is_folder = F.col("obj_type") == FOLDER
    if exclude_files.strip(" ;"):
        rows = rows.where(is_folder | ~matches_any(fold, exclude_files))
    if include_files.strip(" ;"):
        rows = rows.where(is_folder | matches_any(fold, include_files))
    return rows


def enrich(listing: DataFrame) -> DataFrame:
    """The listing (path, name, size, mtime_ns, crtime_ns, obj_type, flags) with all that depends on the row alone."""
    rows = listing.where("path is not null and name is not null")
    rows = rows.withColumns({c: F.when(text.is_ascii(F.col(c)), F.col(c)).otherwise(text.nfc_column(F.when(~text.is_ascii(F.col(c)), F.col(c)))) for c in ("name", "path")})
    fold = text.ascii_fold(F.col("name"))
    rows = rows.withColumns({"name_fold": fold, "path_fold": text.ascii_fold(F.col("path")), "name_ufold": text.unicode_fold(F.col("name")), "path_bare": text.unicode_fold(F.col("path"))})
    ext = text.last_extension(F.col("name_fold"))
    is_folder = F.col("obj_type") == FOLDER
    dot = F.length("name_fold") - F.length(F.substring_index("name_fold", ".", -1))
    package = is_folder & (dot > 1) & F.coalesce(ext.isin(text.PACKAGES), F.lit(False))
    return rows.withColumns(
        {
            "path_ufold": F.coalesce("path_bare", "path_fold"),
            "parent_path": parent_of(F.col("path")),
            "depth": depth_of(F.col("path")),
            "ext": ext,
            "type_mask": F.coalesce(text.type_mask(ext), F.lit(0)),
            "is_dir": is_folder,
            "is_package": package,
            "is_hidden": (F.col("flags").bitwiseAND(F.lit(0x8000)) != 0) | F.col("name").startswith("."),
            "deleted": F.lit(False),
        }
    ).drop("path_bare")


def ingest(listing: DataFrame) -> DataFrame:
    """The `entries` table of a listing of files and folders; the folders above them are added.

    One pass over the ancestors of every row gives the totals of folders, which of them are empty, and
    which are missing.  Partial sums are taken before the shuffle, so folders near the root are no hot
    keys, and only folders are joined with their totals.
    """
    rows = keep_columns(enrich(listing.select("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags")))
    above = keep(sums_above(rows.select("path", F.when(~F.col("is_dir"), F.col("size")).otherwise(0).alias("bytes"))))
    there = rows.where("is_dir").select("path")
    missing = keep(above.select("path").join(there, "path", "left_anti"))
    files = rows.where("not is_dir").join(small(missing), "path", "left_semi").select("path")
    folders = missing.join(files, "path", "left_anti").select(
        "path",
        F.when(F.col("path") == ROOT, F.lit(ROOT)).otherwise(F.substring_index(F.col("path"), "/", -1)).alias("name"),
        *(F.lit(0).cast("long").alias(c) for c in ("size", "mtime_ns", "crtime_ns")),
        F.lit(FOLDER).alias("obj_type"),
        F.lit(0).cast("long").alias("flags"),
    )
    return with_tree(rows.unionByName(enrich(folders)), above)


def sums_above(rows: DataFrame) -> DataFrame:
    """(path, subtree_size): of every folder above one of the rows (path, bytes), the sum below it."""
    up = rows.select(F.explode(ancestors(F.col("path"))).alias("path"), "bytes")
    return up.groupBy("path").agg(F.sum("bytes").cast("long").alias("subtree_size"))


def with_tree(entries: DataFrame, above: DataFrame) -> DataFrame:
    """Adds the columns that depend on other entries: subtree_size, is_dupe, is_empty_dir.

    `above` are the sums of all live entries (`sums_above`): a folder that is not there has nothing below.
    """
    folders = entries.where("is_dir").join(above, "path", "left")
    folders = folders.withColumns({"is_empty_dir": F.col("subtree_size").isNull(), "subtree_size": F.coalesce("subtree_size", F.lit(0).cast("long"))})
    files = entries.where("not is_dir").withColumns({"is_empty_dir": F.lit(False), "subtree_size": F.lit(None).cast("long")})
    names = repeated_names(entries).withColumn("is_dupe", F.lit(True))
    every = files.unionByName(folders).join(names, "name_fold", "left")
    return every.withColumn("is_dupe", F.coalesce("is_dupe", F.lit(False)))


__all__ = ["FILE", "enrich", "excluded", "glob_like", "ingest", "matches_any", "select_listing", "sums_above", "under", "with_tree"]
