"""Shared folders, word patterns and small helpers of the operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor one of the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a record batch while a table is written: texts and sets are long, and batches lie outside the heap.
BATCH_ROWS = 500


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that leaves its worker small: freed memory goes back to the system, not into Arrow's pool."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim()

    return task


def trim() -> None:
    """Give memory that Python has freed back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="cairnbase-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found else "file://" + found.removeprefix("file:")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cairnbase/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Record batches of at most BATCH_ROWS rows for all that the session runs from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path, key = scratch(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Column names of our own beside those of df: each name with as many underscores before it as it takes."""
    used, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = f"_{name}"
        while new.lower() in used:
            new = f"_{new}"
        used.add(new.lower())
        out[name] = new
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def filesystem(path: str):
    """The file system that holds path, with the path on it, from a worker. Any scheme pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
