"""What the engine needs of a session: its code on the workers, kept results, and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of keys that may be broadcast; more are joined by a shuffle.
FEW = 1 << 17
_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the Python workers, once for each application; Arrow functions need it there."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "treesift_engine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def small(keys: DataFrame, at_most: int | None = None) -> DataFrame:
    """The same rows, to be broadcast if they are at most `FEW`; give them kept, as they are counted unless `at_most` is known."""
    if at_most is None or at_most > FEW:
        at_most = keys.limit(FEW + 1).count()
    return F.broadcast(keys) if at_most <= FEW else keys


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="treesift-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def keep_columns(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder by column: for wide tables of which later steps read a few columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that neither reuse nor a lost executor repeats the work."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
