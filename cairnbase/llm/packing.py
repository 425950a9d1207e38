"""Packing by power-of-two decomposition: every sequence is a piece of one document, of a binary length, without padding.

A document of n tokens gives n // longest pieces of the longest length and one for each bit that is set in the rest, the
longest first. Pieces of one length make a bucket, a folder of its own in the stored table, from which batches of equal
shape are read. Texts are not shuffled: pieces are cut and written where the texts are read, and only counts for each
written part are brought together to number the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, lean, scratch, stored
from .tokens import CACHE, GROUP_CHARS, Encoder, in_groups

PIECES = "doc_id long, doc_tokens long, start long, length long, ids binary, part long, place long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("place", pa.int64())])


def decompose(n: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of documents of n tokens: for each length, the longest first, the documents' positions and the pieces' starts.

    The pieces of a document follow one another from 0 to n, as the bits above a set bit say where its piece begins.
    """
    assert longest > 0 and longest & (longest - 1) == 0, "the longest length must be a power of two"
    full = n // longest
    doc = np.repeat(np.arange(len(n)), full)
    yield longest, doc, (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * longest
    for bit in reversed(range(longest.bit_length() - 1)):
        doc = np.flatnonzero(n >> bit & 1)
        yield 1 << bit, doc, n[doc] >> (bit + 1) << (bit + 1)


def _rows(doc_ids: list[int | None], ids: list[np.ndarray], longest: int, part: int, placed: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The pieces of some documents as record batches, each of one length and of a few hundred rows."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, at = np.concatenate(ids).astype("<u4"), np.cumsum(n) - n
    named = np.array([d is None for d in doc_ids])
    known = np.array([d or 0 for d in doc_ids], np.int64)
    for length, doc, start in decompose(n, longest):
        for i in range(0, len(doc), BATCH_ROWS):
            d, s = doc[i : i + BATCH_ROWS], start[i : i + BATCH_ROWS]
            data = flat[(at[d] + s)[:, None] + np.arange(length)]
            ends = np.arange(len(d) + 1, dtype=np.int32) * np.int32(4 * length)
            place = placed.get(length, 0)
            placed[length] = place + len(d)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[d], mask=named[d]), pa.array(n[d]), pa.array(s), pa.array(np.full(len(d), length)), packed, pa.array(np.full(len(d), part)), pa.array(np.arange(place, place + len(d)))],
                schema=_ARROW,
            )


def write_sequences(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048, folder: str | None = None, kept: int = CACHE, group_chars: int = GROUP_CHARS) -> str:
    """Encode docs (doc_id, text), cut them and write the pieces to a folder, one subfolder for each length; returns the folder.

    Each document ends with ``end_id``. A null or empty text is that id alone, a piece of length 1; rows that repeat a doc_id
    and rows without one are documents of their own; other columns are ignored, and an empty table writes no sequence. Texts
    of any length are encoded whole. A part of the table counts once, by Spark's commit of its files.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sequences")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, placed = Encoder.of(tokenizer_path, kept), TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids, done = batch.column("doc_id").to_pylist(), 0
            for texts in in_groups(batch.column("text"), group_chars):
                ids = [np.append(x, np.uint32(end_id)) for x in encoder.many(texts)]
                yield from _rows(doc_ids[done : done + len(ids)], ids, longest, part, placed)
                done += len(ids)

    # one open file for each length, so that no task sorts its pieces by length before it writes them
    conf = {"spark.sql.maxConcurrentOutputFileWriters": str(longest.bit_length()), "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        pieces = docs.select("doc_id", "text").mapInArrow(lean(encode), PIECES)
        pieces.write.partitionBy("length").option("compression", "zstd").parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return folder


def read_sequences(spark, folder: str) -> DataFrame:
    """The sequences of a folder: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    sequence_id numbers the sequences without gaps, the longest bucket first, and in a bucket by written part and place in it;
    offset is 0, as a sequence holds one piece. The counts that number them are a row for each part and length, and stored,
    so that Spark knows their size when it plans the join: while it is small, the pieces are not shuffled.
    """
    fields = [field for field in PIECES.split(", ") if not field.startswith("length ")]
    pieces = spark.read.schema(", ".join([*fields, "length long"])).parquet(folder)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("bucket"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("length", F.coalesce(F.sum("bucket").over(longer), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(buckets, "length")
    bases = stored(parts.select("length", "part", (F.col("first") + F.col("before")).alias("base")), "sequence-bases")
    return pieces.join(bases, ["length", "part"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def with_batches(sequences: DataFrame, batch_tokens: int) -> DataFrame:
    """Sequences with batch: equally long ones in batches of at most batch_tokens tokens, one sequence at least.

    A batch is named by length and number, so batches of different buckets never mix.
    """
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("length")))
    return sequences.withColumn("batch", F.concat_ws("-", F.col("length"), F.floor(F.col("sequence_id") / each)))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048) -> DataFrame:
    """One row for each piece of each document: see write_sequences() and read_sequences()."""
    return read_sequences(docs.sparkSession, write_sequences(docs, tokenizer_path, end_id, longest))
