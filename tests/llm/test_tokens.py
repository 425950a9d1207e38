import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnbase.llm import tokens as T

from .helpers import clash, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64)
    data = T.pack(ids, width)
    assert len(data) == 16 * 8 * width and (T.unpack(data, width, 1000) == ids).all()


def test_width_is_the_least():
    assert [T.vocabulary_bits(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("width", [11, 16])
def test_random_access(width):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 1 << width, n, dtype=np.uint32) for n in (0, 5, 700, 1, 3000)]
    sink = io.BytesIO()
    w = T.Writer(sink, width, block=128)
    for x in lists:
        w.add(x)
    w.close()
    r = T.Reader(sink, len(sink.getvalue()))
    assert all((r.document(i) == x).all() for i, x in enumerate(lists))
    whole = np.concatenate(lists)
    for start, n in ((0, 0), (127, 2), (500, 1300), (len(whole) - 1, 1)):
        assert (r.ids(start, n) == whole[start : start + n]).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1.,' \n\t\xa0é漢<|endoftext|>", max_size=60))
def test_encoder_equals_library(text):
    e = T.Encoder.of(PATH)
    assert e(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [0, 3, 100])
def test_few_kept_pieces_give_the_same_ids(kept):
    T.Encoder.of(PATH).many(["filled before by some other words than these"])
    e = T.Encoder.of(PATH, kept)
    for texts in (["one two three four", "two three"], ["four five one", "six"], ["one two three four", "seven one"]):
        assert [x.tolist() for x in e.many(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(e.cache) <= kept


def test_files(spark):
    texts = ["one two three", None, "", "one two three", "x " * 30000, "é 漢 <|endoftext|> y"]
    ids = [5, 3, None, 5, 2**40, 1]
    for df in (docs(spark, texts, ids=ids), clash(docs(spark, texts, ids=ids)).repartition(3)):
        manifest = T.write_token_files(df, PATH, end_id=2)
        got = [tuple(r) for r in T.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
        tok, at, want = Tokenizer.from_file(PATH), 0, []
        for i, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
            e = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
            at += len(e)
        assert got == want


def test_empty_table(spark):
    assert T.read_token_files(T.write_token_files(docs(spark, []), PATH, end_id=2)).count() == 0
