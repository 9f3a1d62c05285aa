"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from inspect import isgeneratorfunction

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group: a task holds one in memory while it writes.
ROW_GROUP = 32 << 20
_local: dict[str, str] = {}
_recorded: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting (tests) gets a temporary folder;
    a cluster session without it is an error, since machine-local folders are not shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return _local[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there,

    so a lost executor never recomputes what stands before, and every reader sees the same rows. Spark
    deletes the shuffle files of the write when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _recorded:
        paths.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in memory from which a worker gives back what it has freed; below, taking it again costs more than it holds.
TRIMMED_ABOVE = 350 << 20


def in_memory() -> int:
    """Bytes of this process in memory; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as sizes:
            return int(sizes.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def give_back() -> None:
    """Returns what a large Python worker has freed to the machine: allocators keep it, and idle workers stay."""
    if in_memory() < TRIMMED_ABOVE:
        return
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim is not None:
        trim(0)


def trimmed(work: Callable) -> Callable:
    """``work`` on Arrow batches, or on a table, giving back memory when it ends."""

    @wraps(work)
    def of_batches(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    @wraps(work)
    def of_table(table):
        try:
            return work(table)
        finally:
            give_back()

    return of_batches if isgeneratorfunction(work) else of_table


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """The paths of tables stored meanwhile go to ``paths``."""
    _recorded.append(paths)
    try:
        yield
    finally:
        _recorded.remove(paths)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables, wherever they are; nothing may read them any more."""
    context = spark.sparkContext
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
