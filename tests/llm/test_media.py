import hashlib
import zlib

import numpy as np
import pytest

from cairnbase.llm import media as M

from .helpers import clash, docs


@pytest.mark.parametrize("n", [192, 384, 576, 192 * 7, 192 * 41])
def test_payload_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    data = M.encode_payload(payload)
    frame = M.Frame(data)
    assert frame.payload() == payload and frame.rgb().shape == (frame.height, frame.width, 3)
    if n < 1500:  # the same stream bit by bit
        slow = M.Frame(data, vectorised=False)
        assert slow.payload() == payload and (slow.rgb() == frame.rgb()).all()


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes().replace(b"\xff", b"\xff\x00")


def general_file(coefficients):
    """One 8 x 8n grey image by a plain encoder: real run lengths, sizes, end-of-band runs, and one refinement."""
    symbols = sorted({r << 4 | s for r in range(16) for s in range(1, 9)} | {0xF0} | {r << 4 for r in range(8)})
    code = {s: i for i, s in enumerate(symbols)}
    table = lambda kind: M._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    dc_table = M._segment(0xC4, bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    size = lambda v: int(abs(v)).bit_length()
    extra = lambda v: int(v) if v > 0 else int(v) + (1 << size(v)) - 1
    head = b"\xff\xd8" + M._segment(0xDB, b"\0" + b"\x02" * 64) + M._segment(0xC2, b"\x08\0\x08" + (8 * len(coefficients)).to_bytes(2, "big") + b"\x01\x01\x11\0") + dc_table + table(1)
    dc, before = Bits(), 0
    for block in coefficients:
        d = int(block[0]) - before
        before = int(block[0])
        dc.put(size(d), 4)
        if d:
            dc.put(extra(d), size(d))
    first, run = Bits(), 0

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            first.put(code[r << 4], 8)
            first.put(run - (1 << r), r)
            run = 0

    half = np.sign(coefficients) * (np.abs(coefficients) >> 1)
    for block in half:
        zeros = 0
        for k in range(1, 64):
            v = int(block[k])
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                first.put(code[0xF0], 8)
                zeros -= 16
            first.put(code[zeros << 4 | size(v)], 8)
            first.put(extra(v), size(v))
            zeros = 0
        if zeros:
            run += 1
    flush()
    second = Bits()
    for block, had in zip(coefficients, half, strict=True):
        zeros, pending = 0, []
        last = max([k for k in range(1, 64) if block[k] and not had[k]], default=0)
        for k in range(1, 64):
            if had[k]:
                pending.append(int(abs(block[k])) & 1)
                continue
            if not block[k]:
                zeros += 1
                if zeros == 16 and k < last:
                    second.put(code[0xF0], 8)
                    for b in pending:
                        second.put(b, 1)
                    zeros, pending = 0, []
                continue
            second.put(code[zeros << 4 | 1], 8)
            second.put(int(block[k] > 0), 1)
            for b in pending:
                second.put(b, 1)
            zeros, pending = 0, []
        if last < 63:
            second.put(code[0], 8)
            for b in pending:
                second.put(b, 1)
    return head + M._scan(1, 0, 0, 0, 0, 0, 0) + dc.done() + M._scan(1, 0, 0, 1, 63, 0, 1) + first.done() + M._scan(1, 0, 0, 1, 63, 1, 0) + second.done() + b"\xff\xd9"


def test_general_streams():
    rng = np.random.default_rng(4)
    c = (rng.integers(-40, 41, (12, 64)) * (rng.random((12, 64)) < 0.2)).astype(int)
    c[5:8, 1:] = 0  # a run of ended bands
    c[:, 63] = 0
    frame = M.Frame(general_file(c))
    assert (frame.components[1]["c"].reshape(-1, 64) == c).all()
    assert frame.rgb().shape == (8, 96, 3)


def test_inverse_transform_of_a_flat_block():
    c = np.zeros((1, 64), int)
    c[0, 0] = 16
    assert set(M.Frame(general_file(c)).rgb().reshape(-1).tolist()) == {128 + 16 * 2 // 8}


def test_broken_files_fail():
    data = M.encode_payload(b"x" * 192)
    for bad in (b"", b"xx" + data[2:], data[:-40]):
        with pytest.raises((ValueError, IndexError)):
            M.Frame(bad).payload()


def test_query_columns(spark):
    texts = ["short", None, "", "é" * 5000, "short", "x" * 192, "y" * 193]
    got = {}
    for r in M.decode_media(M.encode_media(clash(docs(spark, texts)))).collect():
        got[r["doc_id"]] = r
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[0].asDict() | {"doc_id": 4} == got[4].asDict()
    full = M.decode_media(M.encode_media(docs(spark, ["short"])), tensors=True).head()
    assert len(full["rgb"]) == full["height"] * full["width"] * 3
    assert M.decode_media(M.encode_media(docs(spark, []))).count() == 0
