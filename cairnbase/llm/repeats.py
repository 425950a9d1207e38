"""Removal of repeated byte strings through maximal repeats of an enhanced suffix array.

A suffix array with its common prefixes (LCP) spans a tree of intervals: all suffixes that share a prefix of some
length. A stack scan yields the intervals; one whose suffixes have different bytes to their left is a maximal repeat,
and its members are all its occurrences, not only neighbours in the array.

At corpus scale the array is sparse. Of every string of LEAST bytes one anchor is chosen, the GRAM bytes with the
least hash in it, so that equal strings have equal anchors at equal places. Occurrences of an anchor, with as much
context as a string around it can reach, form one group, over which the array is built. Documents that are equal
as a whole, and anchors whose whole context is equal, are settled before by their hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, stored
from .hashing import mix, substring, sums, tables

LEAST = 100
GRAM = 32
REACH = LEAST - GRAM
#: Per-document side data of at most so many bytes or rows are broadcast to meet the texts; beyond, the join is shuffled.
BROADCAST_BYTES = 48 << 20
BROADCAST_ROWS = 500_000
NO_ID = (1 << 63) - 1
GROUP_BYTES = 1 << 19


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the array, children before parents; lcp[i]: of entries i - 1 and i."""
    stack = [(0, 0)]  # (length, first)
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack[-1][0] > now:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i - 1
        if stack[-1][0] < now:
            stack.append((now, first))


def suffix_array(data: np.ndarray | bytes) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix of each with the one before (prefix doubling, then Kasai)."""
    letters = np.frombuffer(data, np.uint8).tolist() if isinstance(data, bytes) else data.tolist()
    n, rank, step = len(letters), np.array(letters, np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        if n:
            new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank, step = new, step * 2
        if n == 0 or rank[order[-1]] == n - 1 or step > n:
            break
    lcp, k, place, at = np.zeros(n, np.int64), 0, rank.tolist(), order.tolist()
    for i in range(n):
        if place[i] == 0:
            k = 0
            continue
        j = at[place[i] - 1]
        while i + k < n and j + k < n and letters[i + k] == letters[j + k]:
            k += 1
        lcp[place[i]] = k
        k = max(0, k - 1)
    return order, lcp


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of every maximal repeat of at least ``least`` bytes within or across texts.

    Each text ends in a letter of its own, so that no match crosses a text. The interval tree of the array is scanned
    once; an interval counts if the bytes to the left of its suffixes differ (the start of each text is a byte of its
    own). For corpora that fit one array; remove_repeats() works on any size.
    """
    if not texts:
        return []
    data = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64), 256 + i) for i, t in enumerate(texts)])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    order, lcp = suffix_array(data)
    out = []
    for length, first, last in lcp_intervals(lcp.tolist(), least):
        members = order[first : last + 1].tolist()
        left = {int(data[p - 1]) if p > starts[owner[p]] else -1 - int(owner[p]) for p in members}
        if len(left) > 1:
            out.append((length, sorted((int(owner[p]), int(p - starts[owner[p]])) for p in members)))
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` entries."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def anchors_of(group: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of the texts of a group: text, position, hash of the anchor, hash of its context, bytes to its right.

    The context is REACH bytes to the left and LEAST from the anchor on, or less at the ends of the text.
    """
    data = np.frombuffer(b"".join(group), np.uint8)
    n = len(data)
    if n < LEAST:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    lengths = np.array([len(g) for g in group])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = sums(data)
    grams = mix((total[GRAM:] - total[:-GRAM]) * tables(n + 1)[1][: n - GRAM + 1])
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), REACH + 1)
    inside = np.arange(len(least)) <= np.repeat(ends - LEAST, lengths)[: len(least)]
    at = (least[inside] & low).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    text = np.searchsorted(ends, at, "right")
    left, right = np.minimum(at - starts[text], REACH), np.minimum(ends[text] - at, LEAST)
    context = mix(substring(total, at - left, at + right) + left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + right.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return text, at - starts[text], grams[at], context, right


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and b, at most limit."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, limit)


def _rows(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows within their groups."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8")
    return np.lexsort((*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group))


def earlier_reach(place: list[int], common: list[int]) -> list[int]:
    """For entries in the order of their left contexts, place: rank in document order, common: with the entry before.

    For each the longest left context that it shares with an entry of smaller place (-1 if there is none). The best
    partner is the nearest such entry to either side.
    """
    n, out = len(place), [-1] * len(place)
    for direction in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # (place, common prefix with the entry that stands above it)
        for i in direction:
            edge = common[i] if direction.step > 0 else (common[i + 1] if i + 1 < n else 0)
            reach = edge
            while stack and stack[-1][0] > place[i]:
                reach = min(reach, stack.pop()[1])
            if stack:
                out[i] = max(out[i], reach)
            # what stands above an entry must carry the least common prefix on the way down to it
            stack.append((place[i], reach if stack else 0))
    return out


def repeated_spans(group: np.ndarray, doc: np.ndarray, alt: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, start, stop): bytes around anchors that belong to a string of LEAST bytes with an earlier occurrence.

    Rows are anchors with their contexts, left reversed. Rows of a group are arranged as a suffix array by their right
    contexts; each interval of it is then arranged by left contexts, and each row has the longest string that it
    shares with an earlier row of the interval.
    """
    rr, ll = _rows(right, LEAST), _rows(left, REACH)
    nr, nl = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    order = _order(rr, group)
    by_left = np.empty(len(order), np.int64)
    by_left[_order(ll, group)] = np.arange(len(order))
    in_docs = np.empty(len(order), np.int64)
    in_docs[np.lexsort((at, alt, doc))] = np.arange(len(order))
    g = group[order]
    same = np.concatenate(([False], g[1:] == g[:-1]))
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(same[1:], _common(rr[order[1:]], rr[order[:-1]], np.minimum(nr[order[1:]], nr[order[:-1]])), 0)
    # contexts that end inside the other are equal up to there: padding must not count, so lengths bound it
    bounds = np.flatnonzero(~same).tolist() + [len(order)]
    out = []
    pairs = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a == 2]
    if pairs:  # most groups: two occurrences, one interval
        a, b = order[[p[0] for p in pairs]], order[[p[0] + 1 for p in pairs]]
        reach = _common(ll[a], ll[b], np.minimum(nl[a], nl[b]))
        length = lcp[[p[0] + 1 for p in pairs]]
        later = np.where(in_docs[a] > in_docs[b], a, b)
        for i in np.flatnonzero(reach + length >= LEAST).tolist():
            p = int(later[i])
            out.append((p, int(at[p] - reach[i]), int(at[p] + length[i])))
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 3:
            continue
        for length, first, last in lcp_intervals(lcp[a:b].tolist(), GRAM):
            members = order[a + first : a + last + 1]
            members = members[np.argsort(by_left[members])]
            common = np.zeros(len(members), np.int64)
            common[1:] = _common(ll[members[1:]], ll[members[:-1]], np.minimum(nl[members[1:]], nl[members[:-1]]))
            # left-extension diversity: each row is matched as far to the left as an earlier row of the interval agrees
            for p, reach in zip(members.tolist(), earlier_reach(in_docs[members].tolist(), common.tolist()), strict=True):
                if reach >= 0 and reach + length >= LEAST:
                    out.append((p, int(at[p] - reach), int(at[p] + length)))
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


_OCCURRENCE = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("alt", pa.int64()), ("at", pa.int64())])
_FOUND = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("alt", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_SPAN, _EDGE = 0, 1


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts: a, c (hashes of anchor and context), doc, alt, at = position * 128 + bytes to the right.

    Of equal contexts in one group of texts only the first goes on; the others are settled, at = -1 - at."""

    def emit(keys: list, group: list[bytes]) -> pa.RecordBatch:
        text, pos, a, c, right = anchors_of(group)
        doc, alt = (np.array(k, np.int64)[text] for k in zip(*keys, strict=True))
        at = pos * 128 + right
        order = np.lexsort((pos, alt, doc, c, a))
        later = np.concatenate(([False], (a[order[1:]] == a[order[:-1]]) & (c[order[1:]] == c[order[:-1]])))[: len(order)]
        settled = order[later]
        a[settled] = mix((at[settled] + doc[settled]).astype(np.uint64))  # they need no company: dealt out evenly
        at[settled] = -1 - at[settled]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), c.view(np.int64), doc, alt, at)], schema=_OCCURRENCE)

    for batch in batches:
        keys, group, size = [], [], 0
        for doc, alt, text in zip(batch.column("doc").to_pylist(), batch.column("alt").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode()
            if len(data) < LEAST:
                continue
            keys.append((doc, alt))
            group.append(data)
            size += len(data)
            if size >= GROUP_BYTES:
                yield emit(keys, group)
                keys, group, size = [], [], 0
        if group:
            yield emit(keys, group)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all occurrences of each anchor in a partition: spans of equal contexts, and one edge for each different context."""
    table = _gather(batches)
    if table is None:
        return
    a, c, doc, alt, at = (table.column(i).to_numpy() for i in range(5))
    del table
    settled = at < 0
    at = np.where(settled, -1 - at, at)
    pos, right = at >> 7, at & 127
    spans = [np.flatnonzero(settled)]
    rest = np.flatnonzero(~settled)
    rest = rest[np.lexsort((pos[rest], alt[rest], doc[rest], c[rest], a[rest]))]
    if len(rest):
        new_a = np.concatenate(([True], a[rest[1:]] != a[rest[:-1]]))
        new_c = new_a | np.concatenate(([True], c[rest[1:]] != c[rest[:-1]]))
        spans.append(rest[~new_c])
        kinds = np.bincount(np.cumsum(new_a) - 1, new_c)
        edges = rest[new_c & (kinds[np.cumsum(new_a) - 1] > 1)]
    else:
        edges = rest
    spans = np.concatenate(spans)
    for kind, at_rows in ((_SPAN, spans), (_EDGE, edges)):
        if len(at_rows):
            start = pos[at_rows] - np.minimum(pos[at_rows], REACH) if kind == _SPAN else pos[at_rows]
            stop = pos[at_rows] + right[at_rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at_rows), kind, np.int32)), pa.array(doc[at_rows]), pa.array(alt[at_rows]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], schema=_FOUND)


_CONTEXT = pa.schema([("a", pa.int64()), ("doc", pa.int64()), ("alt", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of the edges of each text."""
    weights = tables(GRAM)[0][:GRAM]
    for batch in batches:
        for doc, alt, text, packed in zip(batch.column("doc").to_pylist(), batch.column("alt").to_pylist(), batch.column("text"), batch.column("packed"), strict=True):
            data = text.as_py().encode()
            at = unpack_ints(packed.as_py())
            window = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(GRAM)].astype(np.uint64)
            a = mix(((window + np.uint64(1)) * weights).sum(1, dtype=np.uint64)).view(np.int64)
            where = at.tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(a), pa.array([doc] * len(where), pa.int64()), pa.array([alt] * len(where), pa.int64()), pa.array(at.astype(np.int64)),
                pa.array([data[max(0, p - REACH) : p][::-1] for p in where], pa.binary()), pa.array([data[p : p + LEAST] for p in where], pa.binary()),
            ], schema=_CONTEXT)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _gather(batches)
    if table is None:
        return
    a, doc, alt, at = (table.column(i).to_numpy() for i in range(4))
    found = repeated_spans(a, doc, alt, at, table.column("left").to_pylist(), table.column("right").to_pylist())
    if found:
        rows, start, stop = (np.array(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), pa.array(doc[rows]), pa.array(alt[rows]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], schema=_FOUND)


def pack_ints(x: np.ndarray) -> bytes:
    """Rising integers as compressed differences."""
    return zlib.compress(np.diff(x.astype(np.int32), prepend=np.int32(0)).tobytes(), 1)


def unpack_ints(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32).astype(np.int64))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that overlap or touch made one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate(([True], start[1:] > stop[:-1]))
    last = np.concatenate((first[1:], [True]))
    return start[first], stop[last]


def _by_document(kind: int):
    """Packs the positions (edges) or merged spans of each document of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        doc, alt, start, stop = (table.column(c).to_numpy() for c in ("doc", "alt", "start", "stop"))
        order = np.lexsort((start, alt, doc))
        doc, alt, start, stop = doc[order], alt[order], start[order], stop[order]
        cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1])))).tolist() + [len(doc)]
        packed = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if kind == _EDGE:
                packed.append(pack_ints(np.unique(start[i:j])))
            else:
                packed.append(pack_ints(np.stack(merged(start[i:j], stop[i:j]), 1).reshape(-1)))
        at = cuts[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(alt[at]), pa.array(packed, pa.binary())], ["doc", "alt", "packed"])

    return run


def _beside(df: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """df joined to a stored table of documents: broadcast if that is small, by measure, else shuffled."""
    size = side.agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("b")).collect()[0]
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return df.join(side, ["doc", "alt"], how)


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc, alt, whole, packed: documents with bytes to remove; whole, or the packed bounds of merged spans.

    docs: doc (id, never null), alt (tells rows of one id apart), text.
    """
    n = max(2, shuffle_partitions(docs.sparkSession))
    hashed = docs.select("doc", "alt", F.sha2(F.col("text"), 256).alias("h"))
    heads = hashed.groupBy("h").agg(F.min(F.struct("doc", "alt")).alias("head"), F.count("*").alias("n")).where("n > 1")
    copies = stored(hashed.join(heads, "h").where(F.struct("doc", "alt") != F.col("head")).select("doc", "alt", F.lit(b"").alias("packed")).distinct(), "repeats-copies")
    distinct = _beside(docs, copies, "left_anti")
    found = stored(distinct.mapInArrow(lean(_occurrences), "a long, c long, doc long, alt long, at long").repartition(n, "a").mapInArrow(lean(_settle), "kind int, doc long, alt long, start int, stop int"), "repeats-found")
    edges = stored(found.where(F.col("kind") == _EDGE).repartition(n, "doc", "alt").mapInArrow(lean(_by_document(_EDGE)), "doc long, alt long, packed binary"), "repeats-edges")
    contexts = _beside(docs, edges, "inner").select("doc", "alt", "text", "packed").mapInArrow(lean(_contexts), "a long, doc long, alt long, at long, left binary, right binary")
    compared = contexts.repartition(n, "a").mapInArrow(lean(_compare), "kind int, doc long, alt long, start int, stop int")
    spans = found.where(F.col("kind") == _SPAN).unionByName(compared).repartition(n, "doc", "alt").mapInArrow(lean(_by_document(_SPAN)), "doc long, alt long, packed binary")
    return stored(copies.withColumn("whole", F.lit(True)).unionByName(spans.withColumn("whole", F.lit(False))), "repeats-spans")


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); with texts, also kept (bytes).

    A null text is empty. A byte goes if it is covered by a string of LEAST bytes that also starts earlier: in a
    smaller doc_id (null is the largest) or before in the same document. Rows with one doc_id and equal texts are one
    document and have equal results; with different texts they are documents in the order of a hash of the text.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # ids as a rule are unique: only where they are not are rows told apart by their texts, and equal rows made one
    rows = keyed.groupBy("doc", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    ids = rows.groupBy("doc").agg(F.max("n").alias("equal"), F.count("*").alias("texts")).agg(F.max("equal").alias("equal"), F.max("texts").alias("texts")).head()
    keyed = keyed.withColumn("alt", F.xxhash64("text") if (ids["texts"] or 0) > 1 else F.lit(0).cast("long"))
    long = keyed.select("doc", "alt", "text").where(F.octet_length("text") >= LEAST)
    side = find_repeats(long.dropDuplicates(["doc", "alt"]) if (ids["equal"] or 0) > 1 else long)
    joined = _beside(keyed, side, "left").select("doc_id", "text", "whole", "packed")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        fields.append(("kept", pa.binary()))
        ddl += ", kept binary"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, rows = batch.slice(i, 500), []
                for doc_id, text, whole, packed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "whole", "packed")), strict=True):
                    data = text.encode()
                    spans = [(0, len(data))] if whole else unpack_ints(packed).reshape(-1, 2).tolist() if packed else []
                    kept, at = [], 0
                    for start, stop in spans:
                        kept.append(data[at:start])
                        at = stop
                    rest = b"".join([*kept, data[at:]])
                    row = (doc_id, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
                    rows.append((*row, rest) if texts else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(lean(cut), ddl)
