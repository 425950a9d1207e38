"""Incremental ingest with Structured Streaming: files once by content, stages once by key, and a ledger of what happened."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import Stage, ordered
from ..session import stored
from ..sources.files import describe_files

#: A binary-file stream must be told its schema.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "content_hash string, stage string, input_hash string, status string, error string, seq long"
#: Characters of an error that the ledger keeps.
ERROR_CHARS = 4000


def watch_folder(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that appear under a folder. Files must be renamed into it whole: one seen is never read again.

    Where files are written in place, or must be tried again, use FolderPoller.
    """
    raw = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return describe_files(raw)


def once_by_content(files: DataFrame, within: str | None = None) -> DataFrame:
    """Each content once; within bounds the state to an event-time span (column seen_at)."""
    if within is None:
        return files.dropDuplicates(["content_hash"])
    return files.withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["content_hash"])


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Every event: running, done or error of a stage for a content. seq orders the events of one key."""
    return spark.read.schema(LEDGER).parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], LEDGER)


def jobs(events: DataFrame) -> DataFrame:
    """One row for each key, however often it was tried: the state that its last event left."""
    last = events.groupBy("input_hash").agg(F.max_by(F.struct("content_hash", "stage", "status", "error", "seq"), "seq").alias("j"), F.count_if(F.col("status") == "running").alias("attempts"))
    return last.select("input_hash", "j.content_hash", "j.stage", "j.status", "j.error", "j.seq", "attempts")


def _run(stage_of: dict[str, Stage]):
    """A task that runs the stage of each file's format and tells how it went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = {"content_hash": [], "stage": [], "input_hash": [], "status": [], "error": []}
            for row in batch.to_pylist():
                error = None
                try:
                    stage_of[row["format"]].run(row["content_hash"])
                except Exception as e:  # noqa: BLE001  any failure of a stage is recorded, and ends this source
                    error = repr(e)[:ERROR_CHARS]
                for name, value in (("content_hash", row["content_hash"]), ("stage", row["stage"]), ("input_hash", row["input_hash"]), ("status", "error" if error else "done"), ("error", error)):
                    said[name].append(value)
            yield pa.RecordBatch.from_pydict(said, schema=pa.schema([(n, pa.string()) for n in said]))

    return run


def run_batch(files: DataFrame, stages_for: Callable[[str], list[Stage]], ledger: str) -> None:
    """Run the stages of files (content_hash, format) that have no done row for their key, one stage of all files after the other.

    A breadcrumb of status running is written before a stage runs, and its outcome after; the first error of a file
    halts its later stages. Run again after a failure, what is done is skipped and the rest is tried once more, on the
    same row of jobs(). Stages run on the executors, may run again if a task is lost, and must allow for that.
    """
    spark = files.sparkSession
    formats = [r[0] for r in files.select("format").distinct().collect()]  # a handful
    plans = {f: ordered(stages_for(f)) for f in formats}
    halted = spark.createDataFrame([], "content_hash string")
    for place in range(max(map(len, plans.values()), default=0)):
        now = {f: plan[place] for f, plan in plans.items() if place < len(plan)}
        key = F.coalesce(*[F.when(F.col("format").eqNullSafe(f), stage.input_hash_of(F.col("content_hash"))) for f, stage in now.items()])
        name = F.coalesce(*[F.when(F.col("format").eqNullSafe(f), F.lit(stage.name)) for f, stage in now.items()])
        asked = files.select("content_hash", "format", name.alias("stage"), key.alias("input_hash")).where("input_hash is not null")
        done = jobs(read_ledger(spark, ledger)).where("status = 'done'").select("input_hash")
        due = stored(asked.join(done, "input_hash", "left_anti").join(halted, "content_hash", "left_anti"), "ingest-due")
        if not due.limit(1).count():
            continue
        write = lambda rows: rows.withColumn("seq", F.lit(time.time_ns())).select(*[c.split(" ")[0] for c in LEDGER.split(", ")]).write.mode("append").parquet(ledger)
        write(due.select("content_hash", "stage", "input_hash", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error")))
        outcome = stored(due.repartition("input_hash").mapInArrow(_run(now), "content_hash string, stage string, input_hash string, status string, error string"), "ingest-outcome")
        write(outcome)
        halted = stored(halted.union(outcome.where("status = 'error'").select("content_hash")), "ingest-halted")


def ingest(stream: DataFrame, stages_for: Callable[[str], list[Stage]], ledger: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the stages of each new file, batch by batch, as run_batch() does."""

    def batch(rows: DataFrame, number: int) -> None:
        run_batch(stored(rows.select("content_hash", "format").dropDuplicates(["content_hash"]), "ingest-files"), stages_for, ledger)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


class FolderPoller:
    """Files under a folder that have settled and have not been handled yet, as often as it takes.

    A file is known by its path, time and size, so a changed one is handled again. Only what was handled is marked: a
    handler that fails sees its files again at the next round.
    """

    def __init__(self, spark: SparkSession, folder: str, seen: str, settle: float = 3.0):
        self.spark, self.folder, self.seen, self.settle = spark, folder, seen, settle

    def due(self, now: float | None = None) -> DataFrame:
        """path, modificationTime, length of the files that are at least ``settle`` seconds old and not yet handled."""
        now = time.time() if now is None else now
        files = self.spark.read.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(self.folder).select("path", "modificationTime", "length")
        hidden = F.element_at(F.split("path", "/"), -1).startswith(".")
        settled = files.where(~hidden & (F.col("modificationTime") <= F.timestamp_millis(F.lit(int((now - self.settle) * 1000)))))
        if not _exists(self.spark, self.seen):
            return settled
        known = self.spark.read.schema("path string, modificationTime timestamp, length long").parquet(self.seen)
        return settled.join(known, ["path", "modificationTime", "length"], "left_anti")

    def round(self, handle: Callable[[DataFrame], DataFrame | None], now: float | None = None) -> int:
        """Hand over what is due, with its content; returns how many files were handled.

        The handler gets (path, modificationTime, length, content) and returns the paths (path) that failed, or None;
        these, and all if it raises, stay due.
        """
        due = stored(self.due(now), "poll-due")
        if not due.limit(1).count():
            return 0
        content = self.spark.read.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(self.folder)
        failed = handle(content.join(due, ["path", "modificationTime", "length"], "left_semi"))
        good = due if failed is None else due.join(failed.select("path"), "path", "left_anti")
        good = stored(good, "poll-handled")
        good.write.mode("append").parquet(self.seen)
        return good.count()

    def watch(self, handle: Callable[[DataFrame], DataFrame | None], interval: float = 5.0, rounds: int | None = None) -> None:
        """Rounds without end, or so many; a round whose handler raises is tried again after the interval."""
        n = 0
        while rounds is None or n < rounds:
            n += 1
            try:
                self.round(handle)
            except Exception as e:  # noqa: BLE001  whatever went wrong, the files stay due
                print(f"round {n} failed, to be tried again: {e!r}"[:500])
            if rounds is None or n < rounds:
                time.sleep(interval)


def guard_empty_sweep(found: DataFrame, prior: DataFrame) -> None:
    """Refuse to replace synthesis by nothing: a sweep that found no entity must not wipe an earlier one."""
    if not found.limit(1).count() and prior.limit(1).count():
        raise ValueError("the sweep found nothing; what an earlier one found stays")
