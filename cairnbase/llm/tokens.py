"""Token ids in fixed-width packed files.

File format (little-endian): ``CTID``, version u8, width u8, 2 bytes zero, ids per block u32; then blocks. A block
holds ids in groups of 64, each group in ``width`` words of 64 bits: id i of a group occupies the bits from
i * width on. The footer is an npz-free pair of arrays: for each document its first id, number of ids, its doc_id and whether
it has one (u64, u32, i64, u8) and for each block its byte offset (u64), then ``n_docs u64, n_blocks u64, n_ids u64, footer offset u64, CTID``.
Block offsets allow a read of any id without the ids before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, lean, scratch, shuffle_partitions, stored

MAGIC = b"CTID"
HEADER = struct.Struct("<4sBBHI")
FOOTER = struct.Struct("<QQQQ4s")
#: Ids of a block; a multiple of 64.
BLOCK = 1 << 16
#: White space other than the space, tab and line ends: a text that has any is encoded whole.
RARE_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
RARE_ASCII = "".join(c for c in RARE_SPACE if c.isascii())
#: A space next to these does not begin a piece.
PAIRS = tuple(p for c in " \t\n\r" for p in (f" {c}", f"{c} "))
#: Texts are encoded together up to so many characters.
GROUP_CHARS = 3_000_000
#: Pieces whose ids a worker keeps: the first that it meets, among which are the frequent ones. About 220 bytes each.
CACHE = 500_000


def vocabulary_bits(size: int) -> int:
    """Bits that the ids below size need; 1 at least."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, padded with zeros to a multiple of 64 ids."""
    n = -(-len(ids) // 64)
    if width in (8, 16, 32):  # the general layout, whose groups are then plain arrays
        out = np.zeros(n * 64, f"<u{width // 8}")
        out[: len(ids)] = ids
        return out.tobytes()
    full = np.zeros(n * 64, np.uint64)
    full[: len(ids)] = ids
    full, words = full.reshape(n, 64), np.zeros((n, width), np.uint64)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        words[:, at] |= full[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= full[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of what pack() made, as unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, at + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.reshape(-1)[:n]


def in_groups(column: pa.Array, chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts of a column (null: empty), in lists of about ``chars`` characters."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, sink, width: int, block: int = BLOCK):
        assert block % 64 == 0
        self.sink, self.width, self.block = sink, width, block
        self.at, self.n_ids, self.held, self.pending = 0, 0, [], 0
        self.firsts, self.counts, self.doc_ids, self.offsets = [], [], [], []
        self._put(HEADER.pack(MAGIC, 2, width, 0, block))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray, doc_id: int | None = None) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.n_ids)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.pending += len(ids)
        if self.pending >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, end, self.block):
            self.offsets.append(self.at)
            self._put(pack(ids[i : min(i + self.block, end)], self.width))
        self.held, self.pending = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        at = self.at
        named = np.array([d is not None for d in self.doc_ids], np.uint8)
        doc_ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        self._put(b"".join(x.tobytes() for x in (np.array(self.firsts, "<u8"), np.array(self.counts, "<u4"), doc_ids, named, np.array(self.offsets, "<u8"))))
        self._put(FOOTER.pack(len(self.firsts), len(self.offsets), self.n_ids, at, MAGIC))


class Reader:
    """Reads a file by blocks; source is a random-access file (seek, read)."""

    def __init__(self, source, size: int):
        self.source = source
        magic, version, self.width, _, self.block = HEADER.unpack(self._get(0, HEADER.size))
        n_docs, n_blocks, self.n_ids, at, end = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or end != MAGIC or version != 2:
            raise ValueError("not a token-id file")
        foot = self._get(at, n_docs * 21 + n_blocks * 8)
        self.firsts = np.frombuffer(foot, "<u8", n_docs)
        self.counts = np.frombuffer(foot, "<u4", n_docs, n_docs * 8)
        self.doc_ids = np.frombuffer(foot, "<i8", n_docs, n_docs * 12)
        self.named = np.frombuffer(foot, np.uint8, n_docs, n_docs * 20).astype(bool)
        self.offsets = np.frombuffer(foot, "<u8", n_blocks, n_docs * 21)
        self._kept = (-1, np.empty(0, np.uint32))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids_of_block(self, b: int) -> np.ndarray:
        if self._kept[0] != b:
            n = min(self.block, self.n_ids - b * self.block)
            self._kept = (b, unpack(self._get(int(self.offsets[b]), -(-n // 64) * 8 * self.width), self.width, n))
        return self._kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on."""
        parts, end = [], start + n
        while start < end:
            b, i = divmod(start, self.block)
            part = self.ids_of_block(b)[i : i + end - start]
            parts.append(part)
            start += len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.counts[i]))


class Encoder:
    """Ids of whole texts by the tokenizers library, which encodes each distinct piece once while it is kept.

    Byte-level BPE begins a new piece at every space between two characters that are not white space, so a text is
    the sequence of its parts between spaces. Other texts and other kinds of tokenizers are encoded whole.
    """

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str, kept: int | None = None) -> Encoder:
        """The worker's own encoder, kept from task to task, with at most ``kept`` pieces (None: CACHE)."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        made = cls._made[path]
        made.kept = CACHE if kept is None else kept
        if len(made.cache) > made.kept:
            made.cache.clear()
        return made

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.kept = CACHE
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = list(added.values())
        pre = self.tokenizer.pre_tokenizer
        self.by_piece = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)  # a character for each byte
        for i, token in added.items():
            self.lengths[i] = len(token.encode())
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Encode parts, each with a space before it, as one text, and cut its ids by their lengths in bytes."""
        joined = " " + " ".join(parts)
        ids = self.whole(joined)
        ends = np.cumsum(self.lengths[ids])
        due = np.flatnonzero(np.frombuffer((joined + " ").encode(), np.uint8) == 32)[1:]
        cuts = np.searchsorted(ends, due) + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != due).any():
            raise ValueError("ids that cross a piece")
        data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return {part: data[i:j] for part, i, j in zip(parts, at, at[1:], strict=False)}

    def _in_parts(self, text: str) -> bool:
        """Whether each space of the text begins a piece."""
        if not self.by_piece or " " not in text or text[0] == " " or text[-1] == " ":
            return False
        return not (any(c in text for c in (RARE_ASCII if text.isascii() else RARE_SPACE)) or any(p in text for p in PAIRS) or any(a in text for a in self.added))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers. Equal parts of all the texts are looked up once."""
        split = [i for i, t in enumerate(texts) if self._in_parts(t)]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in set(range(len(texts))).difference(split):
            out[i] = self.whole(texts[i])
        if not split:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in split], pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        index, parts, cache = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        found = list(map(cache.get, parts))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            new = self._learn([parts[i] for i in gaps])
            if len(cache) + len(new) <= self.kept:
                cache.update(new)
            for i in gaps:
                found[i] = new[parts[i]]
        # the first part of a text has no space before it, and so ids of its own
        firsts = self.tokenizer.encode_batch_fast([parts[i] for i in index[offsets[:-1]]], add_special_tokens=False)
        index[offsets[:-1]] = len(found) + np.arange(len(split))
        found += [np.array(f.ids, np.uint32).tobytes() for f in firsts]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[index] - ends + n, n) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[offsets].tolist()
        for i, a, b in zip(split, bounds, bounds[1:], strict=False):
            out[i] = ids[a:b]
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None, folder: str | None = None, kept: int = CACHE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Encode docs (doc_id, text) into files of ascending doc_id; returns the stored manifest (part, path, bytes, n_docs, n_ids).

    Documents are range-partitioned by doc_id (null first), one file for each range; equal doc_ids are ordered by text.
    A file is written under a name of its own for each attempt and only the manifest tells which one counts, so a
    lost executor or a second attempt does no harm. A null text is empty, so it has the end id alone; rows that repeat a
    doc_id, and rows without one, are documents of their own. Other columns are ignored; an empty table gives no file.
    ``kept`` pieces and ``group_chars`` characters bound what a worker holds and cost time alone: the ids are the same.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-ids")
    n = shuffle_partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, sink = Encoder.of(tokenizer_path, kept), None, None
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = Writer(sink, vocabulary_bits(max(encoder.size, (end_id or 0) + 1)))
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for texts in in_groups(batch.column("text"), group_chars):
                for ids in encoder.many(texts):
                    writer.add(np.append(ids, np.uint32(end_id)) if end_id is not None else ids, next(doc_ids))
        if writer is None:
            return
        writer.close()
        sink.close()
        size = writer.at
        row = {"part": [part], "path": [f"{folder}/{name}"], "bytes": [size], "n_docs": [len(writer.firsts)], "n_ids": [writer.n_ids]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(lean(encode), "part long, path string, bytes long, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest, read back from them.

    start counts the ids of all documents before; the window runs over one row for each file. All else is in the files,
    null doc_ids too. An empty manifest gives no row.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", "bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(max(2, shuffle_partitions(manifest.sparkSession)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader = Reader(source, row["bytes"])
                    crc = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(len(reader.firsts))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids, pa.int64(), mask=~reader.named),
                    "start": pa.array(reader.firsts.astype(np.int64) + row["base"]),
                    "n_tokens": pa.array(reader.counts.astype(np.int64)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
