"""Cutting lineage by writing tables to reliable shared storage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Tables between steps are most of what a run writes; this keeps them small.
COMPRESSION = "zstd"

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; on a single machine without one, a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="triledger-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, checksum: Column | None = None) -> DataFrame:
    """The same rows, read back from a table in the checkpoint folder.

    Unlike a cached frame the table survives the loss of executors, and unlike an RDD checkpoint
    it is columnar: later steps read only the columns they need, and the planner knows its size.
    The rows, and a checksum if one is given, are counted while they are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    counted = Observation()
    total = F.lit(None) if checksum is None else F.sum(checksum)
    df.observe(counted, F.count(F.lit(1)).alias("rows"), total.alias("checksum")).write.option("compression", COMPRESSION).parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path, table._known_rows, table._checksum = path, counted.get["rows"], counted.get["checksum"]
    return table


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that `durable` makes meanwhile, in steps run side by side as well."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        place, files = _files(spark, path)
        files.delete(place, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    place, files = _files(spark, path)
    return [str(s.getPath()) for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []


def file_states(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of all files in the paths: other contents give another digest."""
    seen = hashlib.sha256()
    for path in paths:
        place, files = _files(spark, path)
        # One entry a file; the listing stays on the driver, as Spark's own does.
        states, walk = [], files.listFiles(place, True)
        while walk.hasNext():
            s = walk.next()
            states.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
        seen.update("\n".join([path, *sorted(states)]).encode())
    return seen.hexdigest()


def side_by_side(spark: SparkSession, *steps, at_once: int | None = None) -> list:
    """Run independent steps at the same time (no more than `at_once`), so that one step's last tasks do not idle the cluster."""
    shared_folder(spark)
    with ThreadPoolExecutor(len(steps) if at_once is None else min(len(steps), at_once)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(lambda step=step, context=copy_context(): context.run(step))) for step in steps]
        return [step.result() for step in running]


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """The same table, not stored, of which it is known that it has no more than so many rows."""
    df._known_rows = rows
    return df


def known_rows(*tables: DataFrame) -> int | None:
    """The total row count of tables made by `durable`, or the bound of what `bounded` marks."""
    counts = [getattr(t, "_known_rows", None) for t in tables]
    return None if None in counts else sum(counts)


def fingerprint(table: DataFrame) -> tuple:
    """Rows and checksum of a table made by `durable`: equal for equal contents in any order."""
    return table._known_rows, table._checksum
