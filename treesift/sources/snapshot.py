"""Snapshots: immutable generations of the entries table, each with a manifest of its own.

A generation is a base, a Parquet folder with all rows, and the deltas since, Parquet folders with the new
versions of the rows that a batch has changed (`operators.diff.delta`).  So publishing a batch costs
what the batch has changed, and reading overlays the base with the latest version of each path.  When
deltas or deleted rows weigh too much, the next generation is a new base (`compact`).

A manifest is written aside and renamed to `manifest-<generation>.json`, a name that no other has, so
at any moment the highest manifest names a whole generation: a reader sees the old one or the new one, a
job that dies before the rename leaves the old one in force, and of two writers of one generation the
second fails.  Older generations are deleted only when a base is published, and the one before it is
kept for those who still read it.  The files may be in any store that Spark's own file systems reach and
that renames a file as one step.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..operators.diff import overlay, should_compact
from ..operators.tree import live
from .keep import small

VERSION = 2
_MANIFEST = re.compile(r"manifest-(\d+)\.json")
#: A cursor older than this is no basis for catching up: the tree is crawled anew.
STALE_SECONDS = 3 * 86_400
#: Deltas over one base, and their rows as a share of its rows, before a new base is written.
MAX_DELTAS, DELTA_SHARE = 16, (1, 4)


class SnapshotError(Exception):
    """A snapshot that can't be read; nothing has been replaced."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """The generations that have been published, the latest first."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    found = (_MANIFEST.fullmatch(status.getPath().getName()) for status in fs.listStatus(path))
    return sorted((int(m[1]) for m in found if m), reverse=True)


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest in force, or None where there is no snapshot."""
    generations = _manifests(spark, folder)
    if not generations:
        return None
    lines = spark.read.option("wholetext", True).text(f"{folder}/manifest-{generations[0]}.json").collect()
    try:
        found = json.loads(lines[0][0]) if lines else {}
        if found["version"] != VERSION:
            raise SnapshotError(f"version {found['version']} is not {VERSION}")
        StructType.fromJson(found["schema"])
        for key in ("generation", "base", "cursor", "rows", "deleted", "base_rows", "delta_rows"):
            int(found[key])
        [int(x) for x in found["deltas"]], float(found["saved_at"]), float(found["compacted_at"])
    except (ValueError, KeyError, TypeError) as e:
        raise SnapshotError(f"the manifest of {folder} is damaged: {e}") from e
    return found


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    fs, new = _fs(spark, f"{folder}/_{uuid.uuid4().hex}")
    _, path = _fs(spark, f"{folder}/manifest-{manifest['generation']}.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(new, path):
        fs.delete(new, False)
        raise SnapshotError(f"generation {manifest['generation']} of {folder} has been published by another writer")


def _forget(spark: SparkSession, folder: str, manifest: dict, keep_from: int) -> None:
    """Deletes manifests and rows of generations that neither the current one nor the one before needs."""
    fs, path = _fs(spark, folder)
    for status in fs.listStatus(path):
        m = re.fullmatch(r"(?:manifest-|base=|delta=)(\d+)(?:-[0-9a-f]+)?(?:\.json)?", status.getPath().getName())
        if m and int(m[1]) < keep_from and int(m[1]) != manifest["generation"]:
            fs.delete(status.getPath(), True)


def _write(rows: DataFrame, path: str, ordered: bool) -> None:
    if ordered:  # by path, so that row groups are ranges of the tree, which scans prune by folder
        rows = rows.repartitionByRange("path").sortWithinPartitions("path")
    rows.write.mode("error").option("compression", "zstd").parquet(path)


def save(entries: DataFrame, folder: str, cursor: int = 0, now: float = 0.0, keep_deleted: bool = False) -> dict:
    """Writes the next generation as a new base, without deleted rows unless asked for, and publishes it."""
    spark = entries.sparkSession
    before = read_manifest(spark, folder)
    generation = before["generation"] + 1 if before else 0
    rows = (entries if keep_deleted else live(entries)).select(*entries.columns)
    name = f"base={generation}-{uuid.uuid4().hex}"
    _write(rows, f"{folder}/{name}", ordered=True)
    counts = spark.read.schema(rows.schema).parquet(f"{folder}/{name}").agg(F.count("*").alias("rows"), F.count_if("deleted").alias("deleted")).first()
    manifest = {
        "version": VERSION, "generation": generation, "base": generation, "base_name": name, "deltas": [], "delta_names": [], "cursor": cursor, "saved_at": now, "compacted_at": now,
        "rows": counts.rows, "deleted": counts.deleted, "base_rows": counts.rows, "delta_rows": 0, "schema": json.loads(rows.schema.json()),
    }
    _publish(spark, folder, manifest)
    if before:
        _forget(spark, folder, manifest, before["base"])
    return manifest


def append(versions: DataFrame, folder: str, before: dict, cursor: int, now: float = 0.0) -> dict:
    """Publishes the generation after `before`: the same with new versions of rows (kept, one for each path)."""
    spark = versions.sparkSession
    generation = before["generation"] + 1
    schema = StructType.fromJson(before["schema"])
    name = f"delta={generation}-{uuid.uuid4().hex}"
    _write(versions.select(*schema.names), f"{folder}/{name}", ordered=False)
    # what is not in the generation before is new; deleted rows are counted as they stand
    n = versions.count()
    known = _current(spark, folder, before).select("path", F.col("deleted").alias("was")).join(small(versions.select("path"), n), "path", "left_semi")
    was = known.agg(F.count("*").alias("rows"), F.count_if("was").alias("deleted")).first()
    now_deleted = versions.where("deleted").count()
    manifest = before | {
        "generation": generation, "deltas": [*before["deltas"], generation], "delta_names": [*before["delta_names"], name], "cursor": cursor, "saved_at": now,
        "rows": before["rows"] + n - was.rows, "deleted": before["deleted"] + now_deleted - was.deleted, "delta_rows": before["delta_rows"] + n,
    }
    _publish(spark, folder, manifest)
    return manifest


def wants_base(manifest: dict, now: float) -> bool:
    """Whether the next generation should be a new base: too many deltas, or too many deleted rows."""
    heavy = manifest["delta_rows"] * DELTA_SHARE[1] > manifest["base_rows"] * DELTA_SHARE[0]
    deltas = len(manifest["deltas"])
    return deltas >= MAX_DELTAS or deltas > 1 and heavy or should_compact(manifest["rows"], manifest["deleted"], now, manifest["compacted_at"])


def _current(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """The rows of a generation: of each path the version of the last delta that has it."""
    schema = StructType.fromJson(manifest["schema"])
    base = spark.read.schema(schema).parquet(f"{folder}/{manifest['base_name']}")
    if not manifest["deltas"]:
        return base
    parts = [spark.read.schema(schema).parquet(f"{folder}/{n}").withColumn("_generation", F.lit(g)) for g, n in zip(manifest["deltas"], manifest["delta_names"])]
    versions = parts[0]
    for part in parts[1:]:
        versions = versions.unionByName(part)
    if len(parts) > 1:
        latest = Window.partitionBy("path").orderBy(F.desc("_generation"))
        versions = versions.withColumn("_place", F.row_number().over(latest)).where("_place = 1")
    return overlay(base, versions.select(*schema.names))


def load(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """The current generation, or the given one; its schema and identity are checked before anything is returned."""
    manifest = manifest or read_manifest(spark, folder)
    if manifest is None:
        raise SnapshotError(f"there is no snapshot in {folder}")
    schema = StructType.fromJson(manifest["schema"])
    for name in (manifest["base_name"], *manifest["delta_names"]):
        try:
            stored = spark.read.parquet(f"{folder}/{name}").schema
        except Exception as e:
            raise SnapshotError(f"{folder}/{name} can't be read: {e}") from e
        if {(f.name, f.dataType) for f in stored} != {(f.name, f.dataType) for f in schema}:
            raise SnapshotError(f"{folder}/{name} has another schema than its manifest")
    rows = _current(spark, folder, manifest)
    if not rows.where("path is null or name is null or depth is null").isEmpty():
        raise SnapshotError(f"{folder} has rows without a path")
    return rows


def must_rebuild(manifest: dict | None, now: float) -> bool:
    """Whether catching up from the stored cursor is not possible any more."""
    return manifest is None or now - manifest["saved_at"] > STALE_SECONDS
