"""File listings: the columns of one, a crawl of local folders, and the choice of roots."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .keep import keep, ship

ROOT = "/"
FILE, FOLDER, LINK = 1, 2, 5
LISTING = "path string, name string, size long, mtime_ns long, crtime_ns long, obj_type int, flags long, device long"
#: In the flags of a folder that could not be listed.
UNREADABLE = 1 << 40
#: Kinds of volumes that are not crawled.
SKIPPED_KINDS = ("network", "devfs", "system")


def entry(path: str) -> tuple | None:
    """One listing row, or None if the path can't be read."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    folder, link = os.path.isdir(path) and not os.path.islink(path), os.path.islink(path)
    flags = getattr(s, "st_flags", 0)
    created = int(getattr(s, "st_birthtime", s.st_ctime) * 1e9)
    name = path if path == ROOT else os.path.basename(path)
    return (path, name, 0 if folder else s.st_size, s.st_mtime_ns, created, FOLDER if folder else LINK if link else FILE, flags, s.st_dev)


def list_folder(path: str) -> list[tuple] | None:
    """The rows of a folder's children; None if it can't be listed, never a part of them.

    A child that vanishes between the listing and the look at it is gone, and no error.
    """
    try:
        names = sorted(os.listdir(path))
    except OSError:
        return None
    rows = []
    for name in names:
        at = os.path.join(path, name)
        row = entry(at)
        if row is not None:
            rows.append(row)
        elif os.path.lexists(at):
            return None
    return rows


def _relist_batches(batches: Iterator) -> Iterator:
    """For each folder its children, or one row without a name if it can't be listed."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), *((c, pa.int64()) for c in ("size", "mtime_ns", "crtime_ns")), ("obj_type", pa.int32()), ("flags", pa.int64()), ("device", pa.int64())])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = list_folder(folder)
            rows = [(folder, *[None] * 7)] if rows is None else rows
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, schema.types)], schema=schema)


def relist(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing rows of the children of folders (path), the folders that could not be listed)."""
    ship(folders.sparkSession)
    spread = folders.select("path").repartition(max(1, min(folders.sparkSession.sparkContext.defaultParallelism * 4, folders.count() // 16 + 1)))
    found = keep(spread.mapInArrow(_relist_batches, LISTING))
    return found.where("name is not null"), found.where("name is null").select("path")


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


def _outside(path: str, folders: tuple[str, ...]) -> bool:
    return not any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


class _CrawlReader(DataSourceReader):
    """The folders of the upper levels are found first, until there are enough to share; each partition walks
    the subtrees of some of them.  Folders left out, and other roots, are not entered."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.same_device = options.get("sameDevice", "true").lower() == "true"
        self.left_out = tuple(os.path.abspath(x) for x in json.loads(options.get("exclude", "[]")))
        self.tasks = int(options.get("tasks", "64"))

    def _enters(self, row: tuple, device: int) -> bool:
        return row[5] == FOLDER and (not self.same_device or row[7] == device)

    def partitions(self) -> list[InputPartition]:
        device = os.lstat(self.root).st_dev
        upper, level = [], [self.root]
        while level and len(level) < 4 * self.tasks and len(upper) < 16 * self.tasks:
            upper += level
            below = [r for f in level for r in list_folder(f) or [] if self._enters(r, device) and _outside(r[0], self.left_out)]
            level = [r[0] for r in below]
        work = [(f, False) for f in upper] + [(f, True) for f in level]
        return [_Folders(work[k :: self.tasks]) for k in range(min(self.tasks, len(work)))]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        device = os.lstat(self.root).st_dev
        for folder, deep in partition.folders:
            top = entry(folder) if _outside(folder, self.left_out) else None
            todo = [top] if top is not None and self._enters(top, device) else []
            while todo:
                own = todo.pop()
                rows = list_folder(own[0])
                if rows is None and not os.path.lexists(own[0]):  # gone since it was seen
                    continue
                yield own if rows is not None else (*own[:6], own[6] | UNREADABLE, own[7])
                for row in rows or ():
                    if self.same_device and row[7] != device or not _outside(row[0], self.left_out):
                        continue
                    if row[5] != FOLDER:
                        yield row
                    elif deep:
                        todo.append(row)


class CrawlSource(DataSource):
    """`spark.read.format("filetree").load(folder)`: a recursive crawl, for folders that all executors see.

    Options: `sameDevice`, `exclude` (a JSON list of folders that are not entered), `tasks`.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _CrawlReader(self.options)


def crawl(spark: SparkSession, root: str, same_device: bool = True, exclude: list[str] = (), mounts: list[str] = (), tasks: int | None = None) -> DataFrame:
    """The listing of all below a folder; excluded folders and other roots (`mounts`) are not entered."""
    ship(spark)
    spark.dataSource.register(CrawlSource)
    reader = spark.read.format("filetree").option("sameDevice", str(same_device)).option("exclude", json.dumps([*exclude, *mounts]))
    return reader.option("tasks", str(tasks or spark.sparkContext.defaultParallelism * 4)).load(root)


def crawl_stats(listing: DataFrame) -> DataFrame:
    """One row: files, folders and links of a crawl, and the folders that could not be listed."""
    count = lambda t, n: F.count_if(F.col("obj_type") == t).alias(n)
    errors = F.count_if(F.col("flags").bitwiseAND(F.lit(UNREADABLE)) != 0).alias("errors")
    return listing.agg(count(FILE, "files"), count(FOLDER, "folders"), count(LINK, "links"), errors)


def timed_stats(crawled: DataFrame) -> dict:
    """The statistics of a crawl with the seconds it took."""
    began = time.perf_counter()
    return crawl_stats(crawled).first().asDict() | {"seconds": time.perf_counter() - began}


def choose_roots(volumes: DataFrame, custom: DataFrame) -> DataFrame:
    """(path): local volumes (path, kind) and custom roots (path), each path once."""
    kept = volumes.where(~F.col("kind").isin(*SKIPPED_KINDS)).select("path")
    return kept.unionByName(custom.select("path")).distinct()


def root_changes(mounted: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, change): roots that are mounted but not indexed, and the other way round."""
    new = mounted.select("path").exceptAll(indexed.select("path")).withColumn("change", F.lit("mount"))
    gone = indexed.select("path").exceptAll(mounted.select("path")).withColumn("change", F.lit("unmount"))
    return new.unionByName(gone)
