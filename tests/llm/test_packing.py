import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnbase.llm import packing as P

from .helpers import clash, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("longest", [1, 8, 2048])
def test_decomposition(longest):
    n = np.array([0, 1, 2, 7, 8, 9, 15, 16, 2047, 2048, 2049, 6000, 1 << 20])
    got = {i: [] for i in range(len(n))}
    for length, doc, start in P.decompose(n, longest):
        for d, s in zip(doc.tolist(), start.tolist(), strict=True):
            got[d].append((s, length))
    for i, size in enumerate(n.tolist()):
        want, at = [], 0
        while at < size:  # the largest binary length that fits, again and again
            length = min(longest, 1 << (size - at).bit_length() - 1)
            want.append((at, length))
            at += length
        assert sorted(got[i]) == want


TEXTS = ["one two three four five", None, "", "word " * 5000, "é 漢 🙂 <|endoftext|> x", "same row", "same row", "x", "a\n\n b\t c", "tail " * 2046 + "tail"]


def test_pieces_against_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    ids = [0, 1, 2, 3, 2**40, 7, 7, None, -5, 11]
    for df in (docs(spark, TEXTS, ids=ids), clash(docs(spark, TEXTS, ids=ids)).repartition(3)):
        rows = P.pack_documents(df, PATH, end_id=1).withColumn("crc", F.crc32("ids")).collect()
        want = sorted(((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in zip(ids, TEXTS, strict=True)), key=str)
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
        assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)
        by_doc = {}
        for r in rows:
            assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048
            assert len(r.ids) == 4 * r.length and r.crc == zlib.crc32(r.ids)
            by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        got = []
        for i, pieces in by_doc.items():
            for copy in range(2 if i == 7 else 1):  # the two rows with id 7 are equal: deal their pieces out
                own = sorted(pieces)[copy :: 2 if i == 7 else 1]
                flat = [x for _, piece, _ in own for x in piece]
                assert [s for s, _, _ in own] == np.cumsum([0, *(len(p) for _, p, _ in own[:-1])]).tolist()
                assert {n for _, _, n in own} == {len(flat)}
                got.append((i, tuple(flat)))
        assert sorted(got, key=str) == want


def test_buckets_are_folders_that_are_read_alone(spark):
    folder = P.write_sequences(docs(spark, ["a b c d e f g", "x " * 3000, ""]), PATH, end_id=1)
    alone = P.read_sequences(spark, folder).where("length = 2048")
    assert "PartitionFilters: [isnotnull(length" in alone._jdf.queryExecution().toString()
    assert [r.length for r in alone.collect()] == [2048]


def test_batches_have_one_shape(spark):
    texts = [f"{'word ' * (i % 40)}end" for i in range(200)]
    rows = P.with_batches(P.pack_documents(docs(spark, texts), PATH, end_id=1), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r.length)
    assert all(len(set(x)) == 1 and sum(x) <= max(64, x[0]) for x in by.values())
    full = [x for x in by.values() if sum(x) == 64]
    assert len(full) >= len(by) - 12


def test_empty_table(spark):
    assert P.pack_documents(docs(spark, []), PATH, end_id=1).count() == 0
