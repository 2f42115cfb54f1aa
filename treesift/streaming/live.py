"""Keeping a snapshot current from a stream of change events.

An event (seq, path, must_scan) says that something about a path has changed.  A micro-batch gives the
folders to look at again: each event's parent, and the path itself where it is a known folder; each is
listed anew and compared with what the snapshot has (`operators.diff`), folders that are new are
listed in turn, and the new versions of the rows that have changed are published as the next generation.
So a batch costs what it changes; a new base is written only when the snapshot's policy asks for it.

A folder that can't be listed is no empty folder: it is left out of the comparison, nothing below it is
deleted, and it is looked at again with the next batch.

The manifest carries the cursor (the largest seq applied).  It moves only with the generation it
belongs to, and a batch at or below it is skipped, so replayed batches and restarted streams change
nothing.  A batch based on another generation than the current one is rejected.  Events are never
given a watermark on file times: a root has the time zero.  A stream that starts on a snapshot too old to
catch up, and an event that says events were lost, lead to the whole tree being looked at again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff
from ..operators.ingest import ingest, under
from ..operators.tree import live, parent_of
from ..sources import snapshot
from ..sources.keep import keep, small
from ..sources.listing import FOLDER, relist

EVENTS = "seq long, path string, must_scan boolean"
#: Quiet time and least time between refreshes, in seconds, when in use and when not.
REFRESH = {True: (0.35, 1.5), False: (0.6, 3.0)}

#: Gives the listing rows of the children of folders (path); or those, and the folders (path) it could not list.
Lister = Callable[[DataFrame], "DataFrame | tuple[DataFrame, DataFrame]"]


class StaleBatch(Exception):
    """The batch was computed against a generation that is not the current one."""


def dirty_folders(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(path): the parents of the events' paths, and those paths themselves, that are known folders."""
    paths = events.select("path").distinct()
    parents = paths.select(parent_of(F.col("path")).alias("path")).where("path is not null")
    asked = keep(paths.unionByName(parents).distinct())
    return live(entries).where("is_dir").select("path").join(small(asked), "path", "left_semi")


def _listed(lister: Lister, folders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(listing rows, folders that were listed, folders that could not be)."""
    found = lister(folders)
    if not isinstance(found, tuple):
        return found, folders, None
    rows, failed = found
    failed = keep(failed.select("path").distinct())
    return rows, folders.join(small(failed), "path", "left_anti"), failed


def reconcile(entries: DataFrame, folders: DataFrame, lister: Lister, failed: list[DataFrame] | None = None) -> DataFrame:
    """The differences of the given folders and of all folders found new below them, level by level, however deep.

    Folders that could not be listed are appended to `failed`.
    """
    parts, known = [], entries
    while True:
        rows, listed, lost = _listed(lister, folders)
        if lost is not None and failed is not None:
            failed.append(lost)
        parts.append(keep(diff.folder_diff(known, rows, listed)))
        new = F.col("change").isin(diff.ADDED, diff.REPLACED) & (F.col("obj_type") == FOLDER)
        folders = parts[-1].where(new).select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        known = entries.limit(0)


def apply_batch(spark: SparkSession, folder: str, events: DataFrame, lister: Lister, now: float | None = None, expected_generation: int | None = None) -> dict:
    """Applies one batch of events to the snapshot in `folder`; returns the manifest in force after it."""
    now = time.time() if now is None else now
    manifest = snapshot.read_manifest(spark, folder)
    if manifest is None:
        raise snapshot.SnapshotError(f"there is no snapshot in {folder}")
    if expected_generation is not None and manifest["generation"] != expected_generation:
        raise StaleBatch(f"generation {manifest['generation']} is in force, not {expected_generation}")
    fresh = keep(events.where(F.col("seq") > manifest["cursor"]))
    seen = fresh.agg(F.max("seq").alias("last"), F.coalesce(F.max("must_scan"), F.lit(False)).alias("everything")).first()
    if seen.last is None:
        return manifest
    entries = snapshot.load(spark, folder, manifest)
    if seen.everything:
        folders = keep(live(entries).where("is_dir").select("path"))
    else:
        folders = keep(dirty_folders(entries, fresh.select("path").unionByName(_pending(spark, folder, manifest))))
    failed: list[DataFrame] = []
    changes = reconcile(entries, folders, lister, failed)
    diff.change_log(changes, seen.last).write.mode("overwrite").parquet(f"{folder}/log/batch={seen.last}")
    if failed:
        reduce(DataFrame.unionByName, failed).distinct().write.mode("overwrite").parquet(f"{folder}/pending/batch={seen.last}")
    versions = keep(diff.delta(entries, changes))
    manifest = snapshot.append(versions, folder, manifest, cursor=seen.last, now=now)
    if snapshot.wants_base(manifest, now):
        manifest = snapshot.save(snapshot.load(spark, folder, manifest), folder, cursor=manifest["cursor"], now=now)
    return manifest


def _pending(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """(path): the folders that the batch before could not list."""
    path = f"{folder}/pending/batch={manifest['cursor']}"
    fs, at = snapshot._fs(spark, path)
    rows = spark.read.schema("path string").parquet(path) if fs.exists(at) else spark.createDataFrame([], "path string")
    # asked for by a path below, as an event would
    return rows.select(F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/?")).alias("path"))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the change log up to the cursor in force."""
    manifest = snapshot.read_manifest(spark, folder)
    rows = spark.read.schema("path string, kind int, size_delta long, batch long").parquet(f"{folder}/log")
    return rows.where(F.col("batch") <= manifest["cursor"])


def follow(
    spark: SparkSession, events: DataFrame, folder: str, lister: Lister | None = None, checkpoint: str = "", interval: str | None = None, recrawl: Callable[[], DataFrame] | None = None, active: bool = True, throttle: bool = False
) -> StreamingQuery:
    """Starts a stream that applies events to the snapshot: every `interval`, or what is there and no more.

    Without a lister the folders themselves are listed, on the executors.  With `recrawl`, which gives a
    listing of the whole tree, a snapshot that is too old to catch up is replaced first.  With `throttle` batches
    are as far apart as a refresh may be (`REFRESH`).
    """
    lister = lister or relist
    if recrawl is not None:
        rebuild(spark, folder, recrawl)
    if throttle:
        interval = f"{int(1000 * REFRESH[active][1])} milliseconds"
    writer = events.writeStream.foreachBatch(lambda batch, _: apply_batch(spark, folder, batch, lister) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def rebuild(spark: SparkSession, folder: str, recrawl: Callable[[], DataFrame], now: float | None = None, force: bool = False) -> dict:
    """The manifest in force after a snapshot that is missing or too old has been replaced by a new crawl.

    The cursor stays: events that are older than the crawl only lead to folders being listed again.
    """
    now = time.time() if now is None else now
    manifest = snapshot.read_manifest(spark, folder)
    if not force and not snapshot.must_rebuild(manifest, now):
        return manifest
    return snapshot.save(ingest(recrawl()), folder, cursor=manifest["cursor"] if manifest else 0, now=now)


def mount(entries: DataFrame, added: DataFrame) -> DataFrame:
    """The entries with those of a new root; where a stub of the root was listed, it is replaced."""
    columns = entries.columns
    return entries.join(added.select("path"), "path", "left_anti").select(*columns).unionByName(added.select(*columns))


def rescan(entries: DataFrame, root: str, listing: DataFrame) -> DataFrame:
    """The entries with all below a root replaced by what a new crawl of it has found.

    For roots that send no events; run it on a schedule.  An offline root's rows stay until then, and
    the fresh ones take their place, so none is there twice.
    """
    outside = live(entries).where(~under(F.col("path"), root))
    base = ("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags")
    return ingest(outside.where("depth > 0").select(*base).unionByName(listing.where(under(F.col("path"), root)).select(*base)))


def unmount(entries: DataFrame, root: str, keep_offline: bool = False) -> DataFrame:
    """The entries with a root and all below it marked as deleted; or, to be kept offline, as they are.

    Offline rows stay in searches; when the root is there again, `mount` or `rescan` puts the fresh ones in
    their place.
    """
    if keep_offline:
        return entries
    gone = entries.sparkSession.createDataFrame([(root,)], "path string")
    return diff.apply(entries, diff.removed(entries, gone))


def rescan_due(last: float, now: float, minutes: float = 60) -> bool:
    """Whether a root that sends no events is to be crawled again."""
    return now - last >= minutes * 60


def phased(spark: SparkSession, local: DataFrame, cloud: DataFrame, folder: str, now: float | None = None) -> dict:
    """Publishes a snapshot of the local roots' listing first, and one with the cloud roots' as well when that is done.

    Cloud folders are slow to crawl; searches over the local ones need not wait for them.
    """
    now = time.time() if now is None else now
    first = ingest(local)
    snapshot.save(first, folder, now=now)
    base = ("path", "name", "size", "mtime_ns", "crtime_ns", "obj_type", "flags")
    both = live(first).where("depth > 0").select(*base).unionByName(cloud.select(*base)).dropDuplicates(["path"])
    return snapshot.save(ingest(both), folder, now=now)
