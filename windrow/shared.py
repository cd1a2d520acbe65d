"""The folder that driver and executors share, and intermediate tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``.  Only where that is absent and Spark runs within one process (local runs, tests) a
    fresh local folder is chosen and remembered; on a cluster its absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_scope.get() or f'{shared_dir(spark)}/windrow'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """What is written to scratch paths inside goes to one folder, which is deleted at the end: no plan may read it after."""
    folder = scratch(spark, name)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        delete(spark, folder)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and it hides how the rows were partitioned, so that a later
    join shuffles both of its sides and adaptive execution can split a hot key.
    """
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan will read again."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` with the hint to broadcast it if it has ``most`` rows at most, which is looked up; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder within its file system; the parents of ``target`` are made."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where there is no such path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
