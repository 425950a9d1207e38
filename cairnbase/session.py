"""Session factory and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "cairnbase", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset; that only where driver and executors are one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {context.master})")
        found = tempfile.mkdtemp(prefix="cairnbase-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of an input folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in spark.sql.shuffle.partitions parts by a hash of its keys, for work that is not in the bytes.

    A plain repartition by the same keys is left out after a grouping by them, whose parts adaptive execution then joins.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, and later reads take only the columns they need."""
    folder = ensure_checkpoint_dir(df.sparkSession)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    path = f"{folder.rstrip('/')}/cairnbase/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
