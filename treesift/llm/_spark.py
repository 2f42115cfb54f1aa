"""What the operators need of a session: the shared folder, checkpoints, and their code on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a batch of rows that goes to a Python worker, whatever the size of a row.
BATCH_BYTES = 4 << 20
#: Files for each core of what has few and short rows after a shuffle.
FILES = 6
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound their batches unless the session does."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "treesift.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder, so that no later loss repeats the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame) -> DataFrame:
    """The same short rows in at most `FILES` partitions for each core, none of them shuffled.

    Without Hadoop's native library every file that an executor writes to a local disk starts several
    processes (chmod), each of which counts as large as the whole JVM until it runs its own program.
    """
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


def calm_executors(spark: SparkSession) -> int:
    """A full collection on each executor, which shares its memory with the Python workers beside it; returns their number.

    One short task for each, as idle executors get one each.  Sorts take pages of many MB from the heap,
    which grows by them and is not given back without this.  In local mode the driver is the executor.
    """
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if n:
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    return n


def calm(spark: SparkSession) -> None:
    """Give memory that the JVMs don't use back: heaps shrink to what lives; the driver's freed native memory returns to the system.

    Long sequences of small jobs need this: without a full collection a heap only grows, and what
    broadcasts, shuffles and compiled plans have freed stays with the process.
    """
    calm_executors(spark)
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:  # a command of Java 17.0.9 and later on Linux; called by the interface, as the class is not open
        kind, string, objects = jvm.java.lang.Class.forName, "java.lang.String", "[Ljava.lang.Object;"
        kinds = new(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", string, objects, f"[L{string};")):
            kinds[i] = kind(name)
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except Py4JError:
        pass


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
