"""Progressive JPEG as a lossless carrier of bytes, and its decoder to full-resolution RGB tensors.

A payload byte b becomes one quantised coefficient: its upper 7 bits are the magnitude bits of size category 7,
its lowest bit the one that successive approximation adds. The frame is 4:2:0 with 8-bit samples; bytes fill the
luma blocks, then Cb, then Cr, each in zigzag order. Scans: DC and two spectral bands at point transform 1, then a
refinement of DC and of the AC band for each component. The payload's length stands in a comment segment.

The decoder takes any progressive Huffman stream. Where a scan's table has a single symbol, as in the carrier,
all its codes have one length and the scan is decoded as an array; other scans go bit by bit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

UNIT = 192
MCU_BYTES = 384
MAX_ACROSS = 4000  # units of 16 pixels; a side has 65,535 pixels at most
BANDS = ((1, 5), (6, 63))
NOTE = b"payload="
BATCH_BYTES = 8 << 20


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


ZIGZAG = _zigzag()


def _inverse_dct(bits: int = 12) -> np.ndarray:
    """64 x 64: zigzag coefficients to samples, scaled by 2**bits to whole numbers, so that float sums are exact."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(basis, basis).T[ZIGZAG] * (1 << bits))


IDCT = _inverse_dct()
_X7 = np.arange(256) >> 1
_Q7 = np.where(_X7 >= 64, _X7, _X7 - 127)
_LOW = np.arange(256) & 1
#: Coefficient of each byte, in the DC and in an AC position.
DC_OF = (2 * _Q7 + _LOW).astype(np.int16)
AC_OF = (np.sign(_Q7) * (2 * np.abs(_Q7) + _LOW)).astype(np.int16)
#: Byte of each coefficient, by coefficient + 256.
BYTE_OF_DC, BYTE_OF_AC = np.zeros(512, np.uint8), np.zeros(512, np.uint8)
BYTE_OF_DC[DC_OF + 256] = np.arange(256)
BYTE_OF_AC[AC_OF + 256] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, place: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is a single 0."""
    return _segment(0xC4, bytes((kind << 4 | place, 1)) + bytes(15) + bytes((symbol,)))


def _scan(component: int, dc: int, ac: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes((1, component, dc << 4 | ac, first, last, high << 4 | low)))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 32 up to a positive multiple of unit."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def encode_payload(payload: bytes) -> bytes:
    """payload as a progressive JPEG."""
    n = max(1, -(-len(payload) // MCU_BYTES))
    down = -(-n // MAX_ACROSS)
    across = -(-n // down)
    n = down * across
    data = np.zeros(n * MCU_BYTES, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    parts = (blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :])
    high = [p >> 1 for p in parts]
    out = [b"\xff\xd8", _segment(0xFE, NOTE + str(len(payload)).encode()), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00" + b"\x02\x11\x00" + b"\x03\x11\x00"))
    out += [_table(0, 0, 7), _table(1, 0, 7), _table(1, 1, 0), _segment(0xDD, b"\x00\x01")]
    for c, h in enumerate(high):  # DC: a restart after each block, so that no block depends on another
        stream = np.empty((len(h), 3), np.uint8)
        stream[:, 0], stream[:, 1], stream[:, 2] = h[:, 0], 0xFF, 0xD0 + (np.arange(len(h)) & 7)
        out += [_scan(c + 1, 0, 0, 0, 0, 0, 1), stream.tobytes()[:-2]]
    out.append(_segment(0xDD, b"\x00\x00"))
    for c, h in enumerate(high):
        for first, last in BANDS:
            out += [_scan(c + 1, 0, 0, first, last, 0, 1), h[:, first : last + 1].tobytes()]
    for c, p in enumerate(parts):
        low = p & 1
        dc = np.ones(-(-len(p) // 8) * 8, np.uint8)
        dc[: len(p)] = low[:, 0]
        low[:, 0] = 0  # in its place the code of the end of the block
        for first, last, bits in ((0, 0, dc), (1, 63, low)):
            out += [_scan(c + 1, 0, 1, first, last, 1, 0), np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class _Table:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n]:
            x = x << 1 | b
        if self.at + n > len(self.bits):
            raise ValueError("the scan ends early")
        self.at += n
        return x

    def symbol(self, table: _Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


class Frame:
    """A parsed progressive JPEG: coefficient arrays by component, filled scan by scan."""

    def __init__(self, media: bytes, vectorised: bool = True):
        self.vectorised, self.components, self.tables, self.quant, self.restart = vectorised, {}, {}, {}, 0
        self.note, at = b"", 2
        if media[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            if media[at] != 0xFF:
                raise ValueError("no marker where one is due")
            if marker == 0xD9:
                break
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive frame with Huffman codes")
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE and body.startswith(NOTE):
                self.note = body[len(NOTE) :]
            elif marker == 0xDA:
                found = _NEXT.search(media, at)
                if not found:
                    raise ValueError("the last scan has no end")
                self._decode(body, media[at : found.start()])
                at = found.start()

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.h_max, self.v_max = max(s[1] for s in specs), max(s[2] for s in specs)
        across, down = -(-self.width // (8 * self.h_max)), -(-self.height // (8 * self.v_max))
        self.mcus = (down, across)
        for name, h, v, q in specs:
            own = (-(-(-(-self.height * v // self.v_max)) // 8), -(-(-(-self.width * h // self.h_max)) // 8))
            self.components[name] = {"h": h, "v": v, "q": q, "own": own, "c": np.zeros((down * v, across * h, 64), np.int16)}

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0] >> 4, body[0] & 15] = _Table(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[65 + 64 * wide :]

    def _decode(self, head: bytes, data: bytes) -> None:
        n = head[0]
        parts = [(self.components[head[1 + 2 * i]], self.tables.get((0, head[2 + 2 * i] >> 4)), self.tables.get((1, head[2 + 2 * i] & 15))) for i in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if n == 1 and self.vectorised and parts[0][0]["own"] == parts[0][0]["c"].shape[:2] and self._arrays(*parts[0], data, first, last, high, low):
            return
        self._bit_by_bit(parts, data, first, last, high, low)

    def _arrays(self, part: dict, dc: _Table, ac: _Table, data: bytes, first: int, last: int, high: int, low: int) -> bool:
        """Decode a scan whose codes all have one length; False if this is not such a scan."""
        blocks = part["c"].reshape(-1, 64)
        n = len(blocks)
        if first == 0 and high == 0 and dc and dc.only is not None and self.restart == 1 and dc.only == 7:
            raw = np.frombuffer(data + b"\xff\xd0", np.uint8)
            if len(raw) != 3 * n or raw[1::3].min() != 0xFF or raw[0::3].max() > 127:
                return False
            x = raw[0::3].astype(np.int16)
            blocks[:, 0] = np.where(x >= 64, x, x - 127) << low
            return True
        if first > 0 and high == 0 and not self.restart and ac and ac.only == 7 and len(data) == n * (last - first + 1):
            x = np.frombuffer(data, np.uint8).reshape(n, -1)
            if x.size and x.max() > 127:
                return False
            x = x.astype(np.int16)
            blocks[:, first : last + 1] = np.where(x >= 64, x, x - 127) << low
            return True
        if high != low + 1 or self.restart:
            return False
        if first == 0:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if len(bits) < n:
                raise ValueError("the scan ends early")
            blocks[:, 0] |= bits[:n].astype(np.int16) << low
            return True
        band = blocks[:, first : last + 1]
        if ac and ac.only == 0 and band.all():
            width = last - first + 2
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if len(bits) < n * width:
                raise ValueError("the scan ends early")
            bits = bits[: n * width].reshape(n, width)
            if bits[:, 0].any():
                return False
            add = bits[:, 1:].astype(np.int16) << low
            band += np.where(band > 0, add, -add)
            return True
        return False

    def _bit_by_bit(self, parts: list, data: bytes, first: int, last: int, high: int, low: int) -> None:
        if len(parts) == 1:
            part = parts[0][0]
            units = [[(0, r, c)] for r in range(part["own"][0]) for c in range(part["own"][1])]
        else:
            units = [[(i, r * p["v"] + y, c * p["h"] + x) for i, (p, _, _) in enumerate(parts) for y in range(p["v"]) for x in range(p["h"])] for r in range(self.mcus[0]) for c in range(self.mcus[1])]
        pieces = _RESTART.split(data) if self.restart else [data]
        step = self.restart or max(1, len(units))
        for piece, start in zip(pieces, range(0, len(units), step), strict=False):
            bits, before, run = _Bits(piece), [0] * len(parts), 0
            for unit in units[start : start + step]:
                for i, r, c in unit:
                    part, dc, ac = parts[i]
                    block = part["c"][r, c]
                    if first == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            before[i] += bits.value(bits.symbol(dc))
                            block[0] = before[i] << low
                    elif high == 0:
                        run = self._first(bits, ac, block, first, last, low, run)
                    else:
                        run = self._refine(bits, ac, block, first, last, low, run)

    @staticmethod
    def _first(bits: _Bits, table: _Table, block: np.ndarray, k: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        while k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                block[k] = bits.value(size) << low if size else 0
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
        return 0

    @staticmethod
    def _refine(bits: _Bits, table: _Table, block: np.ndarray, k: int, last: int, low: int, run: int) -> int:
        def correct(at: int) -> None:
            if bits.take(1):
                block[at] += (1 << low) if block[at] > 0 else -(1 << low)

        ended = run > 0
        while k <= last and not ended:
            zeros, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = (1 << low) if bits.take(1) else -(1 << low)
            elif zeros < 15:
                run, ended = (1 << zeros) + (bits.take(zeros) if zeros else 0), True
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if ended:
            for at in range(k, last + 1):
                if block[at]:
                    correct(at)
            return run - 1
        return 0

    def payload(self) -> bytes:
        """The bytes that encode_payload() stored."""
        out = []
        for part in self.components.values():
            c = part["c"].reshape(-1, 64) + 256
            b = BYTE_OF_AC[c]
            b[:, 0] = BYTE_OF_DC[c[:, 0]]
            out.append(b.tobytes())
        return b"".join(out)[: int(self.note)]

    def _plane(self, part: dict) -> np.ndarray:
        """Samples of a component, at its own resolution."""
        rows, across, _ = part["c"].shape
        out = np.empty((rows, 8, across, 8), np.uint8)
        q = self.quant[part["q"]]
        step = max(1, 4096 // across)
        for r in range(0, rows, step):
            c = part["c"][r : r + step].reshape(-1, 64)
            x = (c * q if (q != 1).any() else c).astype(np.float64) @ IDCT
            x += (128 << 12) + 2048
            np.clip(x, 0, (256 << 12) - 1, out=x)
            out[r : r + step] = (x.astype(np.int32) >> 12).astype(np.uint8).reshape(-1, across, 8, 8).transpose(0, 2, 1, 3)
        return out.reshape(rows * 8, across * 8)

    def rgb(self) -> np.ndarray:
        """Height x width x 3, all components brought to full resolution by repetition."""
        h, w = self.height, self.width
        parts = list(self.components.values())
        planes = [self._plane(p) for p in parts]
        full = lambda x, p: np.repeat(np.repeat(x, self.v_max // p["v"], 0), self.h_max // p["h"], 1)[:h, :w]
        luma = full(planes[0], parts[0]).astype(np.int16)
        out = np.empty((h, w, 3), np.uint8)
        if len(parts) < 3:
            out[:] = luma[..., None]
            return out
        cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        # the shares of the chroma planes in red, green and blue, times 65536, made before they grow
        adds = ((91881 * cr + 32768) >> 16, (-22554 * cb - 46802 * cr + 32768) >> 16, (116130 * cb + 32768) >> 16)
        for i, add in enumerate(adds):
            out[..., i] = np.clip(luma + full(add.astype(np.int16), parts[1]), 0, 255)
        return out


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean colour in 1/1000 and checksum of a tensor."""
    flat = np.ascontiguousarray(rgb)
    means = [int(flat[..., i].sum(dtype=np.int64)) * 1000 // (flat.shape[0] * flat.shape[1]) for i in range(3)]
    return f"{rgb.shape[1]}x{rgb.shape[0]} rgb {means[0]},{means[1]},{means[2]} crc {zlib.crc32(flat):08x}"


def _flushed(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about BATCH_BYTES."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size > BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as UTF-8, padded, stored as a progressive JPEG.

    One row for each row of docs, whatever its doc_id; a text of any length is stored whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    data = (text.as_py() or "").encode()
                    media = encode_payload(pad(data))
                    yield (i, len(data), media), len(media)

        yield from _flushed(rows(), schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Of (doc_id, n_bytes, media): digests of the stored form and of the payload read back, and the image's feature.

    With tensors, also height, width and rgb, the full-resolution tensor as bytes, row by row.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if tensors:
        fields += [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]
        ddl += ", height int, width int, rgb binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, n, m in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                    data = m.as_py()
                    frame = Frame(data)
                    payload, rgb = frame.payload(), frame.rgb()
                    row = (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(rgb))
                    yield (row + (rgb.shape[0], rgb.shape[1], rgb.tobytes()) if tensors else row), 300 + rgb.size * tensors

        yield from _flushed(rows(), schema)

    return media.mapInArrow(lean(run), ddl)
