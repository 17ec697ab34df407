"""Helpers shared by the corpus operators: tables, keys, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of Arrow batches handed to Python, and the bytes at which a batch is closed early.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of very long texts must still fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, and so is what their allocators hold."""
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back when the task is done."""

    @functools.wraps(run)
    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    released.__annotations__ = dict(run.__annotations__)
    return released


def doc_key() -> Column:
    """64-bit identity of a document among those of its doc_id: rows equal in doc_id and text are the same document. Never null.

    Joins on it that remove something also compare order_of_id(), so that documents of
    different doc_id are never taken for one another.
    """
    return F.xxhash64("doc_id", "text")


def order_of_id() -> Column:
    """doc_id as it orders documents; a null doc_id comes after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


#: Scratch tables made by each open scratch_tables(), the innermost last.
_made: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder that the session names. Where none is set, a local master gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/crawlgauge-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end, also after a failure. What is lazily read from them must be written before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table in the shared folder, whatever file system that is on."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if df, a stored table, is counted to have at most max_rows rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Estimated bytes of a table's rows up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_bytes_up_to(df: DataFrame, size: int) -> DataFrame:
    """Hint a broadcast only if the bytes of df's rows, as counted by the caller, stay within BROADCAST_BYTES."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: A key with more rows than this, and than one in HOT_KEYS of all rows, is hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_heads(rows: DataFrame, heads: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with heads: stored (on, n, ...), one row a key, n: how many rows have the key (all of them, or in proportion). Inner or left_semi.

    Hot keys are HOT_KEYS at most by their definition, so they are broadcast and their rows
    stay where they are; the rows of all other keys are shuffled.
    """
    total = heads.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = heads.where(F.col("n") > most), heads.where(F.col("n") <= most)
    if not hot.limit(1).count():
        return rows.join(rest, on, how)
    there = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on, how).unionByName(rows.join(there, on, "left_anti").join(rest, on, how))
