import gzip
import hashlib
import io

import pytest

from cairnbase.llm import warc as W

PAGES = "page_id long, url string, html string"


def test_normaliser_cuts_one_member_for_each_record():
    records = [W.record(i, f"http://x/{i}\r\nEvil: 1", b"p" * i, None) for i in (0, 10, 5000)] + [W.record(7, None, b"q" * 200, 3)]
    for whole in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        sink = io.BytesIO()
        index = W.normalise(io.BytesIO(whole), sink)
        data = sink.getvalue()
        assert [gzip.decompress(data[a : a + n]) for a, n in index] == records
        assert W.unpack_index(W.pack_index(index)) == index
    revisit = W.parse(gzip.compress(records[3]))
    assert (revisit["page_id"], revisit["record_type"], revisit["refers_to"], revisit["payload_bytes"], revisit["payload"]) == (7, "revisit", 3, 200, None)
    assert b"\nEvil" not in records[0]
    with pytest.raises(ValueError):
        list(W.cut_records(iter([records[0][:-3]])))


def test_a_stream_cut_between_records():
    records = [W.record(i, "u", b"x" * 300, None) for i in range(3)]
    zipper = W.zlib.compressobj(6, W.zlib.DEFLATED, 31)
    cut = zipper.compress(b"".join(records)) + zipper.flush(W.zlib.Z_SYNC_FLUSH)
    with pytest.raises(ValueError, match="member"):
        W.normalise(io.BytesIO(cut), io.BytesIO())
    W.normalise(io.BytesIO(cut + zipper.flush()), io.BytesIO())


def test_chunks_of_any_size():
    records = [W.record(i, "u", b"x" * (i * 37), None) for i in range(5)]
    data = b"".join(records)
    for n in (1, 7, 100, len(data)):
        assert list(W.cut_records(data[i : i + n] for i in range(0, len(data), n))) == records


def test_archives(spark):
    big, other = "é" * 60, "z" * 100
    rows = [(4, "a", big), (2, "b", big), (2, "b", big), (9, None, big), (5, "c", other), (6, "d", "z" * 99), (7, "e", "z" * 99), (8, "f", None), (None, "g", big), (None, "h", "w" * 100), (10, "i", "")]
    df = spark.createDataFrame(rows, PAGES).withColumnRenamed("url", "url")
    for pages in (df, df.selectExpr("*", "'x' as digest", "1 as head", "2 as n", "3 as refers_to").repartition(4)):
        got = W.archive_pages(pages).collect()
        assert len(got) == len(rows)
        first = {}
        for i, _, html in rows:
            if i is not None and html is not None and len(html.encode()) >= 100:
                first[html] = min(first.get(html, i), i)
        want = []
        for i, _, html in rows:
            body = (html or "").encode()
            to = first.get(html)
            revisit = to is not None and to != i
            want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
        key = lambda r: str(tuple(r))
        assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)


def test_empty(spark):
    assert W.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
