"""WARC archives: writing, normalising monolithic gzip files, and reading by a sidecar index.

Archives are first written as one gzip stream for the whole file. The normaliser inflates such a stream once, cuts
it into records as it goes, and rewrites each record as a gzip member of its own beside an index of offsets, by
which a reader opens any record alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, lean, scratch, shuffle_partitions, stored

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: A new archive begins after so many uncompressed bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = struct.Struct("<QQ")
MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _clean(url: str) -> str:
    """A header value has no control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{page_id if page_id is not None else 'none:' + digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with the payload, or a revisit that has the HTTP head alone."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to, digest)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """Headers of the record that data begins with, by lower-case name, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def cut_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, which comes in pieces of any size."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= max(need, 4):
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head, start = headers(bytes(held[: end + 4]))
                need = start + int(head["content-length"]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the last record is cut off")


def inflated(source) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, in pieces; only a piece is held at a time.

    A file whose last member does not reach its end is an error, even if it is cut between two records.
    """
    unzip, begun = zlib.decompressobj(31), False
    while data := source.read(CHUNK):
        while data:
            begun = True
            yield unzip.decompress(data, CHUNK)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, CHUNK)
            if unzip.eof:
                data, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
            else:
                break
    if begun:
        raise ValueError("the last member is cut off")


def normalise(source, sink) -> list[tuple[int, int]]:
    """Rewrite each record of source as a gzip member of its own; returns (offset, length) of the members."""
    at, index = 0, []
    for one in cut_records(inflated(source)):
        zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = zipper.compress(one) + zipper.flush()
        sink.write(member)
        index.append((at, len(member)))
        at += len(member)
    return index


def pack_index(index: list[tuple[int, int]]) -> bytes:
    return b"".join(INDEX.pack(*x) for x in index)


def unpack_index(data: bytes) -> list[tuple[int, int]]:
    return list(INDEX.iter_unpack(data))


def parse(member: bytes) -> dict:
    """A record from its gzip member: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit)."""
    data = zlib.decompress(member, 31)
    head, start = headers(data)
    block = data[start : start + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = head["warc-record-id"].removeprefix("<urn:x-page:").removesuffix(">")
    said = head["warc-payload-digest"].removeprefix("sha256:")
    out = {"page_id": None if page.startswith("none:") else int(page), "record_type": head["warc-type"], "url": head.get("warc-target-uri")}
    if head["warc-type"] == "revisit":
        size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
        return out | {"payload_bytes": size, "payload_digest": said, "refers_to": int(head["warc-refers-to"].removeprefix("<urn:x-page:").removesuffix(">")), "payload": None}
    if hashlib.sha256(payload).hexdigest() != said:
        raise ValueError(f"the payload of page {page} does not have its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": said, "refers_to": None, "payload": payload}


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into gzip archives; returns the stored manifest.

    A null html is an empty payload, a null url is left out. Of equal payloads of at least ``least`` bytes the row
    with the smallest page_id (nulls never are it) is the response and the others revisit it; rows that repeat that
    page_id are responses too. Each attempt writes files of its own name, and only the manifest says which count.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    heads = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("times")).where("times > 1").select(F.col("digest").alias("d"), "head")
    dealt = rows.join(heads, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        sink, done, size, n = None, [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    name = f"whole-{uuid.uuid4().hex}.warc.gz"
                    sink, zipper, size, n, put = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0, 0
                one = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                data = zipper.compress(one)
                sink.write(data)
                size, n, put = size + len(one), n + 1, put + len(data)
                if size >= ARCHIVE_BYTES:
                    data = zipper.flush()
                    sink.write(data)
                    sink.close()
                    done.append((f"{folder}/{name}", put + len(data), n))
                    sink = None
        if sink is not None:
            data = zipper.flush()
            sink.write(data)
            sink.close()
            done.append((f"{folder}/{name}", put + len(data), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), MANIFEST, strict=True)], schema=MANIFEST)

    return stored(dealt.mapInArrow(lean(write), "path string, bytes long, records long"), "warc-written")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive of a manifest into one member for each record with an index beside it; returns the stored manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs.create_dir(root, recursive=True)
                name = f"{root}/records-{uuid.uuid4().hex}.warc.gz"
                own, at = filesystem(path)
                with own.open_input_stream(at, compression=None) as source, fs.open_output_stream(name, compression=None) as sink:
                    index = normalise(source, sink)
                with fs.open_output_stream(f"{name}.idx", compression=None) as sink:
                    sink.write(pack_index(index))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([sum(n for _, n in index)], pa.int64()), pa.array([len(index)], pa.int64())], schema=MANIFEST)

    spread = manifest.repartition(max(2, shuffle_partitions(manifest.sparkSession)), "path")
    return stored(spread.mapInArrow(lean(run), "path string, bytes long, records long"), "warc-records")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of normalised archives, each opened by its offset in the index."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        fields.append(("payload", pa.binary()))
        ddl += ", payload binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(f"{at}.idx", compression=None) as source:
                    index = unpack_index(source.read())
                with fs.open_input_file(at) as source:
                    held = []
                    for offset, size in index:
                        source.seek(offset)
                        one = parse(source.read(size))
                        held.append(one if payloads else {k: v for k, v in one.items() if k != "payload"})
                        if len(held) >= 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    spread = manifest.repartition(max(2, shuffle_partitions(manifest.sparkSession)), "path")
    return spread.mapInArrow(lean(run), ddl)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages, normalise the archives, read them back: the rows of read_archives()."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder), folder))
