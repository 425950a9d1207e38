"""PDF files from lines of text, ruling lines, links and outlines: an export, and the other side of the reader's tests."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Width of every character, in thousandths of the font size.
WIDTH = 500


@dataclass
class Page:
    """lines: (x, y, size, bold, text); rules: (x0, y0, x1, y1); links: (x0, y0, x1, y1, page from 1 or name of a destination)."""

    lines: list[tuple] = field(default_factory=list)
    rules: list[tuple] = field(default_factory=list)
    links: list[tuple] = field(default_factory=list)
    width: float = 612
    height: float = 792


class _Codes(dict):
    """Codes of characters (code points), from 1 on in the order of their first use; str.translate() looks them up."""

    def __missing__(self, char: int) -> int:
        self[char] = code = len(self) + 1
        return code


def _stream(data: bytes, more: str = "") -> bytes:
    packed = zlib.compress(data, 1)  # the digits of the codes pack well at any level
    return f"<< /Length {len(packed)} /Filter /FlateDecode{more} >>\nstream\n".encode() + packed + b"\nendstream"


def _string(text: str) -> str:
    return "<FEFF" + text.encode("utf-16-be").hex() + ">"


def _to_unicode(codes: _Codes) -> bytes:
    pairs = [f"<{code:04x}> <{chr(char).encode('utf-16-be').hex()}>" for char, code in codes.items()]
    parts = [f"{len(pairs[i : i + 100])} beginbfchar\n" + "\n".join(pairs[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(pairs), 100)]
    return ("/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "".join(parts) + "endcmap end").encode()


def _page_content(page: Page, codes: _Codes) -> bytes:
    out = [f"{a:g} {b:g} m {c:g} {d:g} l S" for a, b, c, d in page.rules]
    shown, at = "".join([line[4] for line in page.lines]).translate(codes).encode("utf-16-be", "surrogatepass").hex(), 0
    for x, y, size, bold, text in page.lines:
        out.append(f"BT /{'F2' if bold else 'F1'} {size:g} Tf {x:g} {y:g} Td <{shown[at : (at := at + 4 * len(text))]}> Tj ET")
    return "\n".join(out).encode()


def write_pdf(pages: Iterable[Page], toc: Iterable[tuple[int, str, int]] = (), names: dict[str, int] | None = None, packed: bool = True) -> bytes:
    """The bytes of a file. toc: (level, title, page from 1); names: named destinations and their pages.

    ``packed`` files keep their objects in an object stream under a cross-reference stream, others in a plain table. All
    characters are of one width and shown in a composite font with a character map, so any text can be written.
    """
    pages, toc, names, codes = list(pages), list(toc), names or {}, _Codes()
    objects: list[bytes] = []

    def add(body: str | bytes) -> int:
        objects.append(body.encode() if isinstance(body, str) else body)
        return len(objects)

    catalog, tree = add(""), add("")
    contents = [add(_stream(_page_content(p, codes))) for p in pages]
    mapped = add(_stream(_to_unicode(codes)))
    fonts = []
    for base in ("Plain", "Plain-Bold"):
        descriptor = add(f"<< /Type /FontDescriptor /FontName /{base} /Flags 4 >>")
        inner = add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{base} /DW {WIDTH} /FontDescriptor {descriptor} 0 R >>")
        fonts.append(add(f"<< /Type /Font /Subtype /Type0 /BaseFont /{base} /Encoding /Identity-H /DescendantFonts [{inner} 0 R] /ToUnicode {mapped} 0 R >>"))
    first = len(objects) + 1
    for page, content in zip(pages, contents, strict=True):
        add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {page.width:g} {page.height:g}] /Contents {content} 0 R /Annots [] /Resources << /Font << /F1 {fonts[0]} 0 R /F2 {fonts[1]} 0 R >> >> >>")
    at = lambda page: f"[{first + page - 1} 0 R /Fit]"
    for i, page in enumerate(pages):
        notes = [f"<< /Type /Annot /Subtype /Link /Rect [{a:g} {b:g} {c:g} {d:g}] /Dest {at(to) if isinstance(to, int) else _string(to)} >>" for a, b, c, d, to in page.links]
        objects[first + i - 1] = objects[first + i - 1].replace(b"/Annots []", f"/Annots [{' '.join(notes)}]".encode())
    more = ""
    if names:
        pairs = " ".join(f"{_string(k)} {at(p)}" for k, p in sorted(names.items()))
        more += f" /Names << /Dests << /Names [{pairs}] >> >>"
    if toc:
        root, entries = len(objects) + 1, len(objects) + 2
        parents, stack = [], []
        for i, (level, _, _) in enumerate(toc):
            while stack and toc[stack[-1]][0] >= level:
                stack.pop()
            parents.append(stack[-1] if stack else -1)
            stack.append(i)
        children: dict[int, list[int]] = {}
        for i, p in enumerate(parents):
            children.setdefault(p, []).append(i)
        ends = lambda i: f" /First {entries + children[i][0]} 0 R /Last {entries + children[i][-1]} 0 R" if i in children else ""
        add(f"<< /Type /Outlines{ends(-1)} >>")
        for i, (_, title, page) in enumerate(toc):
            siblings = children[parents[i]]
            k = siblings.index(i) if len(siblings) < 50 else _place(siblings, i)
            following = f" /Next {entries + siblings[k + 1]} 0 R" if k + 1 < len(siblings) else ""
            add(f"<< /Title {_string(title)} /Parent {root if parents[i] < 0 else entries + parents[i]} 0 R /Dest {at(page)}{following}{ends(i)} >>")
        more += f" /Outlines {root} 0 R"
    objects[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R{more} >>".encode()
    objects[tree - 1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{first + i} 0 R' for i in range(len(pages)))}] >>".encode()
    return _packed(objects) if packed else _plain(objects)


def _place(ordered: list[int], value: int) -> int:
    from bisect import bisect_left

    return bisect_left(ordered, value)


def _plain(objects: list[bytes]) -> bytes:
    out, places, size = [b"%PDF-1.4\n"], [], 9
    for i, body in enumerate(objects, 1):
        places.append(size)
        out.append(f"{i} 0 obj\n".encode() + body + b"\nendobj\n")
        size += len(out[-1])
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out.append(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{size}\n%%EOF\n".encode())
    return b"".join(out)


def _packed(objects: list[bytes]) -> bytes:
    loose = [i for i, body in enumerate(objects, 1) if body.endswith(b"endstream")]
    apart = set(loose)
    inner = [i for i in range(1, len(objects) + 1) if i not in apart]
    head, body, at = [], [], 0
    for i in inner:
        head.append(f"{i} {at}")
        body.append(objects[i - 1])
        at += len(objects[i - 1]) + 1
    heads = " ".join(head).encode() + b"\n"
    holder, table = len(objects) + 1, len(objects) + 2
    where = {i: (2, holder, k) for k, i in enumerate(inner)}
    out, size = [b"%PDF-1.7\n"], 9
    for i, data in [*((i, objects[i - 1]) for i in loose), (holder, _stream(heads + b"\n".join(body), f" /Type /ObjStm /N {len(inner)} /First {len(heads)}"))]:
        where[i] = (1, size, 0)
        out.append(f"{i} 0 obj\n".encode() + data + b"\nendobj\n")
        size += len(out[-1])
    where[table] = (1, size, 0)
    rows = [(0, 0, 0), *(where[i] for i in range(1, table + 1))]
    # each row after a PNG "up" predictor, as most writers do
    plain = np.frombuffer(b"".join([struct.pack(">BII", kind, a, b << 8)[:8] for kind, a, b in rows]), np.uint8).reshape(-1, 8)
    data = np.insert(np.diff(plain, axis=0, prepend=np.zeros((1, 8), np.uint8)), 0, 2, axis=1).tobytes()
    info = f" /Type /XRef /Size {table + 1} /W [1 4 3] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 8 >>"
    out.append(f"{table} 0 obj\n".encode() + _stream(data, info) + f"\nendobj\nstartxref\n{size}\n%%EOF\n".encode())
    return b"".join(out)
