"""Session helpers: shipping the package to executors and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Rows that Python gets at once: a batch is held by the JVM, on its way, and twice by Python.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of the executors, once for each application, and bound the session's Arrow batches by BATCH_ROWS."""
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        configured = f"file://{folder}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them back, so that scans stay column-pruned."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run inside hand Python at most so many rows at once, which bounds the memory of wide rows."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries now, rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and give heap back, between steps that leave little behind.

    A heap that once grew stays grown while young collections suffice, beside Python workers that need the memory. A task
    for each core reaches all executors while nothing else runs; those that get none keep their heap, and nothing else changes.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def drop(*tables: DataFrame) -> None:
    """Remove the files behind tables that `stored` has returned; whatever was made from them must be stored by now."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))
