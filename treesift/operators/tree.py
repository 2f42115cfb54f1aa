"""Operators over the tree of entries, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.listing import ROOT

DEPTH_CAP = 4096


def parent_of(path: Column) -> Column:
    """The folder of a path; null for the root."""
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    return F.when(path != ROOT, F.when(cut == "", F.lit(ROOT)).otherwise(cut))


def depth_of(path: Column) -> Column:
    """The number of folders above a path."""
    return F.when(path == ROOT, F.lit(0)).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def ancestors(path: Column) -> Column:
    """The paths of all folders above a path, the root first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.transform(above, lambda p: F.when(p == "", F.lit(ROOT)).otherwise(p))
    return F.when(path == ROOT, F.array().cast("array<string>")).otherwise(above)


def live(entries: DataFrame) -> DataFrame:
    return entries.where("not deleted")


def folder_totals(entries: DataFrame) -> DataFrame:
    """(path, subtree_size): bytes of all live entries below a folder that are no folders.

    Partial sums are taken before the shuffle, so the folders near the root are no hot keys.
    """
    sized = live(entries).where("not is_dir and size <> 0").select(F.explode(ancestors(F.col("path"))).alias("path"), "size")
    return sized.groupBy("path").agg(F.sum("size").alias("subtree_size"))


def subtree_size(entries: DataFrame, folder: str) -> DataFrame:
    """One row: the bytes below one folder, by its path prefix, which scans prune by."""
    prefix = folder if folder == ROOT else folder + "/"
    below = live(entries).where("not is_dir").where(F.col("path").startswith(prefix))
    return below.agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("subtree_size"))


def selection_total(entries: DataFrame) -> DataFrame:
    """One row: the bytes of the given entries without folders."""
    return entries.agg(F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0).cast("long")).alias("total"))


def repeated_names(entries: DataFrame) -> DataFrame:
    """(name_fold) of names that more than one live entry has."""
    return live(entries).groupBy("name_fold").count().where("count > 1").select("name_fold")


def empty_folders(entries: DataFrame) -> DataFrame:
    """(path) of live folders without live children."""
    alive = live(entries)
    parents = alive.select(F.col("parent_path").alias("path")).where("path is not null").distinct()
    return alive.where("is_dir").select("path").join(parents, "path", "left_anti")


def children(entries: DataFrame) -> DataFrame:
    """(parent_path, n, names): the children of every folder that has some, counted."""
    return live(entries).where("parent_path is not null").groupBy("parent_path").agg(F.count("*").alias("children"))


def paths_from_parents(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(id, path, depth) of nodes (id, parent, name) that name their parent; a root's parent is -1.

    A root's name is its path; the root `/` adds no component of its own.
    """
    nodes.createOrReplaceTempView("treesift_nodes")
    return spark.sql(
        f"""
        WITH RECURSIVE reached(id, path, depth) MAX RECURSION LEVEL {DEPTH_CAP} AS (
          SELECT id, name, 0 FROM treesift_nodes WHERE parent = -1
          UNION ALL
          SELECT n.id, concat(CASE WHEN r.path = '/' THEN '' ELSE r.path END, '/', n.name), r.depth + 1
          FROM reached r JOIN treesift_nodes n ON n.parent = r.id
        ) SELECT id, path, depth FROM reached LIMIT ALL
        """
    )


def resolve(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The live entries of the given paths (path); what is not there is left out."""
    return live(entries).join(paths.select("path").distinct(), "path", "left_semi")
