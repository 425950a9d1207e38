import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnbase.sources import pdf
from cairnbase.sources.pdf_content import Canvas, aligned_tables, font_table, glyph_text, line_text, ruled_tables, text_lines, to_unicode
from cairnbase.sources.pdf_objects import Lexer, Name, Pdf, PdfError, Ref
from cairnbase.sources.pdf_writer import Page, write_pdf


def hand_made(objects, root=1):
    """A file of the given object bodies under a plain cross-reference table."""
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n%\xe2\xe3\n")
    for i, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n" % i + body + b"\nendobj\n")
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, root, at))
    return out.getvalue()


def stream(data, info=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(data), info) + data + b"\nendstream"


HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /FirstChar 32 /Widths [" + b"500 " * 95 + b"] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi 200 /uni6F22] >> >>"


def one_page(content, info=b"", more=(), resources=b""):
    return hand_made([
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 300 400] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] /Resources << /Font << /F1 5 0 R >> " + resources + b" >> >>", stream(content, info), HELVETICA, *more,
    ])


def shown(spark, *contents):
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "file_id long, content binary")
    parts = pdf.read_pdfs(df)
    return parts, pdf.page_items(parts)


def test_values():
    lexer = Lexer(rb"<< /A#20b [1 -2.5 .5 true null (a\(b\)\\(c)\n\101) <48 6 > 7 0 R] >> % note" + b"\n/N Tj")
    assert lexer.next() == {"A b": [1, -2.5, 0.5, True, None, b"a(b)\\(c)\nA", b"H`", Ref(7)]}
    assert lexer.next() == Name("N") and lexer.next() == b"Tj" and lexer.next() is None


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40))
def test_literal_strings_round_trip(data):
    escaped = data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    assert Lexer(b"(" + escaped + b")").next() == data


def test_lines_sizes_and_weights(spark):
    content = b"q 2 0 0 2 0 0 cm BT /F1 8 Tf 20 100 Td (Two) Tj ( words) Tj ET Q BT /F1 10 Tf 12 TL 1 0 0 1 40 150 Tm [(sp) -600 (aced) 20 (!)] TJ T* (\\001\\002\\310 ) Tj (next) ' ET BT /F1 10 Tf 200 126 Td (far) Tj ET"
    parts, items = shown(spark, one_page(content), one_page(zlib.compress(content), b"/Filter /FlateDecode"))
    rows = [(r.file_id, r.page, r.text, r["size"], r.bold) for r in pdf.lines(items).orderBy("file_id", "ord").collect()]
    want = [("Two words", 16.0), ("sp aced!", 10.0), ("éfi漢", 10.0), ("next", 10.0), ("far", 10.0)]
    assert rows == [(f, 1, t, s, True) for f in (0, 1) for t, s in want]


@pytest.mark.parametrize("name", ["hex", "85", "lzw", "tiff"])
def test_filters(spark, name):
    import base64

    content = b"BT /F1 10 Tf 50 50 Td (filtered text text text) Tj ET"
    if name == "hex":
        data, info = content.hex().encode() + b">", b"/Filter /ASCIIHexDecode"
    elif name == "85":
        data, info = base64.a85encode(content) + b"~>", b"/Filter [/ASCII85Decode]"
    elif name == "lzw":  # codes of 9 bits, the table never grows past them
        bits = "".join(f"{c:09b}" for c in [256, *content, 257])
        data, info = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), b"/Filter /LZWDecode"
    else:
        row = np.frombuffer(content, np.uint8)
        data, info = zlib.compress(np.diff(row, prepend=np.uint8(0)).astype(np.uint8).tobytes()), b"/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns %d >>" % len(content)
    _, items = shown(spark, one_page(data, info))
    assert [r.text for r in pdf.lines(items).collect()] == ["filtered text text text"]


def test_forms_images_and_figures(spark):
    form = stream(b"BT /F1 10 Tf 5 5 Td (in a form) Tj ET /Im Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F1 5 0 R >> /XObject << /Im 7 0 R >> >>")
    raw = bytes(range(256)) * 48
    image = stream(zlib.compress(raw[: 64 * 64 * 3]), b"/Type /XObject /Subtype /Image /Width 64 /Height 64 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode")
    icon = stream(b"\0" * 9, b"/Subtype /Image /Width 3 /Height 3 /ColorSpace /DeviceGray /BitsPerComponent 8")
    jpeg = stream(b"\xff\xd8jpeg", b"/Subtype /Image /Width 80 /Height 90 /Filter /DCTDecode")
    content = b"/Fm Do q 50 0 0 40 10 20 cm /Jp Do Q"
    pages = [b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /Fm 6 0 R /Ic 8 0 R /Jp 9 0 R >> >> >>"] * 2
    data = hand_made([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 10 0 R] /Count 2 >>", pages[0], stream(content), HELVETICA, form, image, icon, jpeg, pages[1]])
    parts, items = shown(spark, data)
    assert [(r.page, r.text, r.x0) for r in pdf.lines(items).orderBy("ord").collect()] == [(1, "in a form", 105.0), (2, "in a form", 105.0)]
    rows = pdf.figures(parts, items).orderBy("xref").collect()
    assert [(r.page, r.xref, r.width, r.height, r.format) for r in rows] == [(1, 7, 64, 64, "png"), (1, 9, 80, 90, "jpeg")]
    assert rows[1].bbox.asDict() == {"x0": 10.0, "y0": 20.0, "x1": 60.0, "y1": 60.0} and bytes(rows[1].data) == b"\xff\xd8jpeg"
    body = bytes(rows[0].data)
    idat = zlib.decompress(body[body.index(b"IDAT") + 4 : body.index(b"IEND") - 8])
    assert b"".join(idat[i + 1 : i + 193] for i in range(0, len(idat), 193)) == raw[: 64 * 64 * 3]


PAGES = [Page(lines=[(72, 700, 11, False, f"page {i} " + "word " * 30)], links=[(0, 0, 9, 9, i % 5 + 1), (0, 0, 9, 9, "d3"), (0, 0, 9, 9, "gone")]) for i in range(1, 6)]
TOC = [(1, "One", 2), (2, " Sub ", 3), (3, "", 3), (1, "Two", 4)]


@pytest.mark.parametrize("packed", [True, False])
def test_outline_links_and_chunks(spark, packed):
    data = write_pdf(PAGES, TOC, {"d3": 3}, packed)
    broken = data.replace(b"startxref\n", b"startxref\n7")  # falls back to a scan for objects
    parts, items = shown(spark, data, broken)
    outline = pdf.chapters(parts, pdf.lines(items))
    rows = [(r.file_id, r.ord, r.level, r.title, r.page_start, r.page_end, r.parent_ord, r.source) for r in outline.orderBy("file_id", "ord").collect()]
    want = [(0, 1, "One", 2, 3, None), (1, 2, "Sub", 3, 3, 0), (2, 3, "(untitled 2)", 3, 3, 1), (3, 1, "Two", 4, 5, None)]
    assert rows == [(f, *w, "outline") for f in (0, 1) for w in want]
    links = sorted(((r.src_page, r.dst_page, r.src_chapter, r.dst_chapter, r.target_label) for r in pdf.internal_links(parts, outline).where("file_id = 0").collect()), key=str)
    chapter = {1: None, 2: 0, 3: 2, 4: 3, 5: 3}
    title = {None: None, 0: "One", 2: "(untitled 2)", 3: "Two"}
    want = [(p, d, chapter[p], chapter[d], title[chapter[d]]) for p in range(1, 6) for d in (p % 5 + 1, 3)]
    assert links == sorted(want, key=str)
    got = pdf.chunks(pdf.lines(items), outline).where("file_id = 0").orderBy("ord").collect()
    assert [(r.page, r.ord, r.chapter_ord) for r in got] == [(p, p - 1, chapter[p]) for p in range(1, 6)] and all(r.text.startswith(f"page {r.page} word") for r in got)


def test_headings_without_an_outline(spark):
    pages = [Page(lines=[(72, 760, 16, True, f"{i} Head"), (72, 700, 11, False, "body text " * 9), (72, 20, 18, True, "Running foot")]) for i in range(1, 7)]
    parts, items = shown(spark, write_pdf(pages))
    rows = pdf.chapters(parts, pdf.lines(items)).orderBy("ord").collect()
    assert [(r.ord, r.level, r.title, r.page_start, r.page_end, r.source) for r in rows] == [(i - 1, 1, f"{i} Head", i, i, "heading_detect") for i in range(1, 7)]


def test_a_file_of_many_pages_is_dealt_out(spark):
    pages = [Page(lines=[(72, 700, 11, i % 7 == 0, f"page {i}")]) for i in range(1, 301)]
    _, items = shown(spark, write_pdf(pages))
    assert [r.text for r in pdf.lines(items).orderBy("ord").collect()] == [f"page {i}" for i in range(1, 301)]
    assert items.where("kind = 'line'").count() == 300


def test_broken_files_are_error_rows(spark):
    good = write_pdf([PAGES[0]])
    locked = hand_made([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>"]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    circle = hand_made([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", b"3 0 R"])
    parts, items = shown(spark, None, b"", b"not one", locked, good[:200], good, circle, b"%PDF-1.4\n" + b"[" * 5000)
    bad = {r.file_id: r.error for r in pdf.errors(parts).collect()}
    assert {0, 1, 2, 3, 4, 7} <= set(bad) and 5 not in bad and "encrypted" in bad[3]
    assert {r.file_id for r in pdf.lines(items).collect()} == {5}


def test_empty_table(spark):
    parts, items = shown(spark)
    outline = pdf.chapters(parts, pdf.lines(items))
    for df in (parts, items, outline, pdf.internal_links(parts, outline), pdf.tables(items), pdf.figures(parts, items), pdf.chunks(pdf.lines(items), outline)):
        assert df.count() == 0


def canvas(page):
    data = Pdf(write_pdf([page]))
    _, found = next(data.pages())
    fonts = data.dict(data.dict(found["Resources"])["Font"])
    out = Canvas({i: font_table(data, data.dict(f)) for i, f in enumerate(fonts.values())}, {})
    out.run(data.decoded(data.get(found["Contents"])), {"fonts": {name: i for i, name in enumerate(fonts)}})
    return out


def test_grids_against_what_was_drawn():
    rng = np.random.default_rng(1)
    for _ in range(40):
        page, want = Page(), []
        for top in (740, 380):
            rows, columns = rng.integers(1, 7), rng.integers(2, 5)
            xs = 50 + np.cumsum([0, *rng.integers(60, 110, columns)])
            ys = top - np.cumsum([0, *rng.integers(16, 40, rows)])
            cells = [["".join(rng.choice(list("abcXYZ ")) for _ in range(rng.integers(0, 8))).strip() for _ in range(columns)] for _ in range(rows)]
            if rows * columns > 1 and any(t for r in cells for t in r):
                want.append([[" ".join(t.split()) for t in r] for r in cells])
                page.rules += [(xs[0], y, xs[-1], y) for y in ys] + [(x, ys[-1], x, ys[0]) for x in xs]
                page.lines += [(x + 4, y - 12, 8, False, " ".join(t.split())) for y, r in zip(ys, cells, strict=False) for x, t in zip(xs, r, strict=False) if t]
        page.lines.append((50, 30, 8, False, "text below the tables"))
        c = canvas(page)
        assert [cells for cells, _ in ruled_tables(c.rules, c.spans)] == want


def test_columns_by_gaps():
    page = Page(lines=[(72, 700, 10, False, "A sentence over the table that is long")])
    page.lines += [(x, 680 - 14 * i, 10, False, f"r{i}c{j}") for i in range(4) for j, x in enumerate((72, 160, 300))]
    page.lines += [(72, 600, 10, False, "two"), (200, 600, 10, False, "cells only once")]
    c = canvas(page)
    assert [cells for cells, _ in aligned_tables(c.spans)] == [[[f"r{i}c{j}" for j in range(3)] for i in range(4)]]
    assert [line_text(x) for x in text_lines(c.spans)][0] == "A sentence over the table that is long"


def test_glyphs_and_character_maps():
    assert [glyph_text(n) for n in ("A", "eacute", "Odieresis", "fi", "uni20AC", "u1F642", "hyphen", "nothing", "a.alt")] == ["A", "é", "Ö", "fi", "€", "🙂", "-", "", "a"]
    table = b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <0002> <0004> <0061> <10> <11> [<0058> <00590059>] endbfrange"
    assert to_unicode(table) == {1: "A", 2: "a", 3: "b", 4: "c", 16: "X", 17: "YY"}
    with pytest.raises(PdfError):
        Pdf(b"nothing")


def test_sections_are_linear(spark):
    import time

    from pyspark.sql import functions as F

    from cairnbase.operators.structure import section_bounds

    def seconds(n):
        toc = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 7919 % 6 + 1).cast("int").alias("level"), (F.col("id") + 1).cast("int").alias("page"), F.lit(n).alias("total_pages"))
        began = time.perf_counter()
        section_bounds(toc).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 20


def test_files_and_their_parts_are_dealt_out(spark, tmp_path):
    from cairnbase.plans import pdf_queries

    grouped = spark.range(400).selectExpr("id % 40 AS file_id", "id").groupBy("file_id").agg({"id": "count"})
    files = pdf_queries._files(grouped, lambda row: write_pdf([PAGES[0]], packed=row["file_id"] % 2 == 0))
    assert len(files.inputFiles()) == 4
    parts = pdf.read_pdfs(files.coalesce(1))
    assert len(parts.inputFiles()) == 4 and parts.where("kind = 'page'").count() == 40


def test_a_long_text_is_cut_in_linear_time(spark, tmp_path):
    import time

    from cairnbase.plans import pdf_queries

    spark.createDataFrame([(1, "  \t\x0b" + "word é \n" * 250_000), (2, None), (3, " \n ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.perf_counter()
    files = {r.file_id: bytes(r.content) for r in pdf_queries._documents(spark, str(tmp_path)).collect()}
    assert time.perf_counter() - began < 15
    whole = "word é " * 250_000
    assert len(list(Pdf(files[1]).pages())) == -(-(len(whole) - 1) // 2400) and len(list(Pdf(files[2]).pages())) == len(list(Pdf(files[3]).pages())) == 1


def test_only_the_kinds_asked_for(spark):
    page = Page(lines=[(60, 700, 9, False, "a"), (160, 700, 9, False, "b"), (60, 680, 9, False, "c")], rules=[(50, y, 250, y) for y in (715, 695, 675)] + [(x, 675, x, 715) for x in (50, 150, 250)])
    parts, items = shown(spark, write_pdf([page]))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for kinds in (["line"], ["table"], ["line", "placed"], []):
        assert rows(pdf.page_items(parts, kinds)) == rows(items.where(items.kind.isin(kinds)))
    assert items.where("kind = 'table'").count() == 1


def test_text_objects_whole_and_token_by_token():
    fonts = {1: {"wide": True, "bold": False, "text": {1: "a", 2: "bc", 0xD800: "x"}, "widths": {2: 700.5}, "default": 333.3}, 2: {"wide": False, "bold": True, "text": {65: "A", 32: " "}, "widths": {}, "default": 500.0}}
    names = {"fonts": {"F1": 1, "F2": 2}}
    shapes = [b"BT /%b %b Tf %b %b Td <%b> Tj ET" % x for x in [(b"F1", b"10", b"-7.5", b".5", b"0001000200030002d800"), (b"F2", b"12.", b"+3", b"4", b"4120414241"), (b"F9", b"9", b"1", b"1", b"41"), (b"F1", b"8", b"0", b"0", b"000")]]
    plain = b"\n".join(shapes)
    moved = b"1 0 0.5 2 3 4 cm 2 Tc 3 Tw 80 Tz 1.5 Ts\n" + plain
    for content in (plain, moved):
        whole, apart = Canvas(fonts, {}), Canvas(fonts, {})
        whole.run(content, names)
        apart.run(content.replace(b"BT", b"BT % apart\n"), names)
        assert whole.spans == apart.spans and len(whole.spans) >= 2


def test_tables_and_heads_of_objects_are_read_at_once(monkeypatch):
    import random
    import re

    from cairnbase.sources import pdf_objects

    whole = write_pdf([Page(lines=[(72, 700, 9, False, "a")])] * 30, packed=False)
    calls, real = [], Lexer.next
    with monkeypatch.context() as patch:
        patch.setattr(Lexer, "next", lambda self: calls.append(self) or real(self))
        opened = Pdf(whole)
        assert all(opened.get(Ref(n)) is not None for n in opened.places if n)
        assert len(calls) < 2 * len(opened.places)  # was 7: three for each entry and each head

    def read(data):
        try:
            opened = Pdf(data)
            return opened.places, opened.trailer, [opened.get(Ref(n)) for n in opened.places]
        except (PdfError, ValueError, TypeError, KeyError, IndexError) as e:
            return str(e)

    rng = random.Random(13)
    small = write_pdf([Page(lines=[(72, 700, 9, False, "a")])] * 2, packed=False)
    table = small.rindex(b"xref\n0 ")
    odd = [small, write_pdf([Page()]), small.replace(b" n \n", b" n\n"), small.replace(b" n \n", b" n\r\n"), small.replace(b" 0 obj\n", b"\r0\tobj\n"), small.replace(b" 0 obj\n", b" 0 objx"), small[: table + 150], small[:table] + small[table:].replace(b"xref\n0 ", b"xref\n0 1\n0000000000 65535 f \n% more\n0 "), small.replace(b"xref\n0 ", b"xref\n00"), small.replace(b"xref\n0 ", b"xref\n0 -")]
    for _ in range(150):
        data = bytearray(small)
        for _ in range(3):
            data[rng.choice([rng.randrange(len(data)), rng.randrange(table + 7, len(data))])] = rng.choice(b" \n\r0159nfR%/<x")
        odd.append(bytes(data))
    found = [read(data) for data in odd]
    for name in ("_HEAD", "_ENTRIES"):
        monkeypatch.setattr(pdf_objects, name, re.compile(rb"(?!)"))
    assert found == [read(data) for data in odd] and len({str(f) for f in found}) > 20
