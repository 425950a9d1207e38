"""PDF files as tables: pages, lines, chapters, chunks, internal links, tables and figures.

The files are taken apart once, into one row for each page, font, form, outline entry, link, named destination and image.
Pages are then dealt out in runs, each with the fonts and forms of its file before it, so that a file of thousands of
pages is no single task's work. Everything after that (destinations, headings, sections, chapters of pages, first
occurrences of images) is joins and windows over those rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, table_markdown
from ..operators.structure import chunk_pages, detect_headings, page_chapters, section_bounds
from ..session import dealt, stored
from .files import best_figures
from .pdf_content import Canvas, aligned_tables, font_table, line_text, ruled_tables, text_lines
from .pdf_objects import Pdf, PdfError, Ref, Stream

PARTS = (
    "file_id long, kind string, page int, ord int, number long, name string, target int, level int, title string, "
    "x0 double, y0 double, x1 double, y1 double, width int, height int, format string, info string, data binary, error string"
)
ITEMS = "file_id long, page int, kind string, ord int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>"
#: Pages that one run of a task takes, and rows and bytes of content of a record batch.
RUN_PAGES, BATCH, BATCH_BYTES = 64, 4096, 1 << 22
#: Kinds of items that a page can show.
KINDS = ("line", "table", "placed")
#: Room for the lines of a page in a line's ord.
PAGE_LINES = 1 << 20


def _text(value: Any) -> str | None:
    """A text string: UTF-16 with its mark, UTF-8 with its mark, or one byte a character."""
    if not isinstance(value, (bytes, str)):
        return None
    if isinstance(value, str):
        return str(value)
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")


def _png(data: bytes, width: int, height: int, colors: int) -> bytes:
    """Eight-bit samples as a PNG file."""
    rows = b"".join(b"\0" + data[i * width * colors : (i + 1) * width * colors] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[colors], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


class _File:
    """The rows of one file."""

    def __init__(self, data: bytes):
        self.pdf = Pdf(data)
        self.pages = list(self.pdf.pages())
        self.page_of = {ref.number: i for i, (ref, _) in enumerate(self.pages, 1) if ref}
        self.known: dict[str, dict] = {"font": {}, "form": {}, "image": {}}
        self.made = 0

    def number(self, value: Any) -> int:
        """The object number of a resource; values that stand in place get a negative one."""
        if isinstance(value, Ref):
            return value.number
        self.made -= 1
        return self.made

    def destination(self, value: Any) -> tuple[int | None, str | None]:
        """Page and name of a destination, whichever it has."""
        value = self.pdf.get(value)
        if isinstance(value, dict):
            value = self.pdf.get(value.get("D"))
        if isinstance(value, list) and value:
            page = value[0]
            return (self.page_of.get(page.number) if isinstance(page, Ref) else page + 1 if isinstance(page, int) and 0 <= page < len(self.pages) else None), None
        return None, _text(value)

    def target(self, holder: dict) -> tuple[int | None, str | None]:
        """Of a link or an outline entry; nothing for actions that leave the file."""
        if "Dest" in holder:
            return self.destination(holder["Dest"])
        action = self.pdf.dict(holder.get("A"))
        return self.destination(action.get("D")) if self.pdf.get(action.get("S")) == "GoTo" else (None, None)

    def resources(self, value: Any) -> tuple[dict[str, dict[str, int]], list[dict]]:
        """Names of fonts, forms and images with their numbers, and the rows of those not met before."""
        names: dict[str, dict[str, int]] = {"fonts": {}, "forms": {}, "images": {}}
        rows, todo = [], self.pdf.dict(value)
        for name, font in self.pdf.dict(todo.get("Font")).items():
            names["fonts"][name] = number = self.number(font)
            if number not in self.known["font"]:
                self.known["font"][number] = True
                rows.append({"kind": "font", "number": number, "info": json.dumps(font_table(self.pdf, self.pdf.dict(font)))})
        for name, held in self.pdf.dict(todo.get("XObject")).items():
            found = self.pdf.get(held)
            kind = found.info.get("Subtype") if isinstance(found, Stream) else None
            if kind not in ("Form", "Image"):
                continue
            number = self.number(held)
            names["forms" if kind == "Form" else "images"][name] = number
            if kind == "Form" and number not in self.known["form"]:
                self.known["form"][number] = True
                inner, more = self.resources(found.info.get("Resources") or value)
                matrix = [float(self.pdf.get(x)) for x in self.pdf.list(found.info.get("Matrix"))] or [1, 0, 0, 1, 0, 0]
                rows += [*more, {"kind": "form", "number": number, "info": json.dumps(inner | {"matrix": matrix}), "data": self.pdf.decoded(found)}]
        return names, rows

    def images(self, value: Any, page: int, seen: set[int]) -> Iterator[dict]:
        """The images among a page's resources and those of its forms; the data of each on its first page alone."""
        for held in self.pdf.dict(self.pdf.dict(value).get("XObject")).values():
            found, number = self.pdf.get(held), held.number if isinstance(held, Ref) else 0
            if not isinstance(found, Stream) or number in seen:
                continue
            seen.add(number)
            if found.info.get("Subtype") == "Form":
                yield from self.images(found.info.get("Resources"), page, seen)
            elif found.info.get("Subtype") == "Image":
                width, height = (int(self.pdf.get(found.info.get(k)) or 0) for k in ("Width", "Height"))
                first = self.known["image"].setdefault(number, page) == page
                kind, data = self.raster(found, width, height) if first else (None, None)
                yield {"kind": "image", "page": page, "number": number, "width": width, "height": height, "format": kind, "data": data}

    def raster(self, image: Stream, width: int, height: int) -> tuple[str, bytes]:
        """Format and bytes of an image file; samples of other layouts than 8-bit grey or RGB are given raw."""
        last = [name for name, _ in self.pdf.filters(image)][-1:]
        data = self.pdf.decoded(image)
        if last in (["DCTDecode"], ["DCT"]):
            return "jpeg", data
        if last == ["JPXDecode"]:
            return "jp2", data
        colors = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(self.pdf.get(image.info.get("ColorSpace"))))
        if colors and self.pdf.get(image.info.get("BitsPerComponent")) == 8 and len(data) >= width * height * colors > 0:
            return "png", _png(data, width, height, colors)
        return "raw", data

    def outline(self) -> Iterator[dict]:
        todo, seen, n = [(self.pdf.dict(self.pdf.trailer.get("Root")).get("Outlines"), 0)], set(), 0
        while todo:
            ref, level = todo.pop()
            node = self.pdf.dict(ref)
            key = ref.number if isinstance(ref, Ref) else id(node)
            if not node or key in seen:
                continue
            seen.add(key)
            if level:
                page, name = self.target(node)
                yield {"kind": "toc", "ord": n, "level": level, "title": _text(self.pdf.get(node.get("Title"))), "target": page, "name": name}
                n += 1
                if "Next" in node:
                    todo.append((node["Next"], level))
            if "First" in node:
                todo.append((node["First"], level + 1))

    def named(self) -> Iterator[dict]:
        root = self.pdf.dict(self.pdf.trailer.get("Root"))
        found = list(self.pdf.dict(root.get("Dests")).items())
        todo, seen = [self.pdf.dict(root.get("Names")).get("Dests")], set()
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref) and ref.number in seen:
                continue
            seen.add(ref.number if isinstance(ref, Ref) else 0)
            node = self.pdf.dict(ref)
            todo += self.pdf.list(node.get("Kids"))
            flat = self.pdf.list(node.get("Names"))
            found += list(zip(map(self.pdf.get, flat[::2]), flat[1::2], strict=False))
        for name, dest in found:
            page, _ = self.destination(dest)
            if page:
                yield {"kind": "name", "name": _text(name), "target": page}

    def page_rows(self, i: int, page: dict) -> Iterator[dict]:
        names, rows = self.resources(page.get("Resources"))
        yield from rows
        content = self.pdf.get(page.get("Contents"))
        streams = [self.pdf.get(c) for c in (content if isinstance(content, list) else [content])]
        data = b"\n".join(self.pdf.decoded(s) for s in streams if isinstance(s, Stream))
        box = [float(self.pdf.get(v)) for v in self.pdf.list(page.get("MediaBox"))] or [0.0, 0.0, 612.0, 792.0]
        yield {"kind": "page", "page": i, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "info": json.dumps(names), "data": data}
        yield from self.images(page.get("Resources"), i, set())
        for k, annot in enumerate(self.pdf.list(page.get("Annots"))):
            note = self.pdf.dict(annot)
            if self.pdf.get(note.get("Subtype")) == "Link":
                target, name = self.target(note)
                box = [float(self.pdf.get(v)) for v in self.pdf.list(note.get("Rect"))] + [None] * 4
                if target or name:
                    yield {"kind": "link", "page": i, "ord": k, "target": target, "name": name, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3]}

    def rows(self) -> Iterator[dict]:
        yield from self.outline()
        yield from self.named()
        for i, (_, page) in enumerate(self.pages, 1):
            try:
                yield from self.page_rows(i, page)
            except (PdfError, ValueError, TypeError, KeyError, IndexError) as e:
                yield {"kind": "error", "page": i, "error": f"{type(e).__name__}: {e}"[:500]}


def packed_rows(rows: Iterable[dict], ddl: str, content: str) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of up to BATCH rows, closed when the bytes of the column ``content`` come to BATCH_BYTES."""
    schema, held, size = _arrow(ddl), [], 0
    for row in rows:
        held.append(row)
        size += len(row.get(content) or b"")
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def read_pdfs(files: DataFrame) -> DataFrame:
    """The parts of PDF files (file_id, content), see PARTS; a row of kind ``error`` for a file or page that cannot be read. Stored.

    Null and empty content are such files too; other columns are ignored, and rows that repeat a file_id must be one file's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[dict]:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    for row in _File(content.as_py() or b"").rows():
                        yield {"file_id": file_id, **row}
                except (PdfError, ValueError, TypeError, KeyError, IndexError, RecursionError) as e:
                    yield {"file_id": file_id, "kind": "error", "error": f"{type(e).__name__}: {e}"[:500]}

        for batch in batches:
            yield from packed_rows(rows(batch), PARTS, "data")

    return stored(dealt(files.select("file_id", "content"), "file_id").mapInArrow(run, PARTS), "pdf-parts")


def _page_items(row: dict, fonts: dict, forms: dict, kinds: Iterable[str] = KINDS) -> Iterator[dict]:
    canvas = Canvas(fonts, forms)
    canvas.run(row["data"] or b"", json.loads(row["info"]))
    n = 0
    for spans in text_lines(canvas.spans) if "line" in kinds else ():
        if len(spans) == 1:
            s = spans[0]
            if text := s.text.strip():
                yield {"kind": "line", "ord": n, "text": text, "size": s.size, "bold": s.bold, "x0": s.x0, "y0": s.y, "x1": s.x1, "y1": s.y + s.size}
                n += 1
            continue
        full = [s for s in spans if s.text.strip()]
        if full and (text := line_text(spans)):
            yield {"kind": "line", "ord": n, "text": text, "size": max([s.size for s in full]), "bold": any([s.bold for s in full]), "x0": full[0].x0, "y0": full[0].y, "x1": full[-1].x1, "y1": full[0].y + full[0].size}
            n += 1
    if "table" in kinds:
        ruled = ruled_tables(canvas.rules, canvas.spans)
        inside = lambda s: any(b[0] <= s.x0 <= b[2] and b[1] <= s.y <= b[3] for _, b in ruled)
        found = [("ruled", t) for t in ruled] + [("aligned", t) for t in aligned_tables([s for s in canvas.spans if not inside(s)])]
        for i, (how, (cells, box)) in enumerate(found):
            yield {"kind": "table", "ord": i, "text": how, "cells": cells, **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))}
    for i, (number, *box) in enumerate(canvas.images if "placed" in kinds else ()):
        yield {"kind": "placed", "ord": i, "text": number, **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))}


def page_items(parts: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """What the pages show, see ITEMS: lines, tables (text: ruled or aligned) and placed images (text: the image's number), or some kinds of these. Stored."""
    kinds = tuple(kinds)
    runs = parts.where("kind = 'page'").withColumn("run", F.floor(F.col("page") / RUN_PAGES))
    kept = parts.where("kind in ('font', 'form')").join(runs.select("file_id", "run").distinct(), "file_id")
    fields = ["file_id", "run", "kind", "page", "number", "info", "data"]
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as the work is not in the bytes by which Spark would join partitions
    dealt = runs.select(*fields).unionByName(kept.select(*fields)).repartition(tasks, "file_id", "run").sortWithinPartitions("file_id", "run", F.col("kind") == "page", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, fonts, forms = None, {}, {}
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["file_id"], row["run"]) != now:
                        now, fonts, forms = (row["file_id"], row["run"]), {}, {}
                    if row["kind"] == "font":
                        font = json.loads(row["info"])
                        fonts[row["number"]] = font | {k: {int(c): v for c, v in font[k].items()} for k in ("text", "widths")}
                    elif row["kind"] == "form":
                        forms[row["number"]] = json.loads(row["info"]) | {"content": row["data"] or b""}
                    else:
                        for item in _page_items(row, fonts, forms, kinds):
                            item["file_id"], item["page"] = row["file_id"], row["page"]
                            yield item

        yield from packed_rows(rows(), ITEMS, "text")

    return stored(dealt.mapInArrow(run, ITEMS), "pdf-items")


def lines(items: DataFrame) -> DataFrame:
    """file_id, page, ord, text, size, bold, x0, y0, x1, y1 of the lines; ord rises through the pages of a file."""
    order = F.col("page").cast("long") * PAGE_LINES + F.col("ord")
    return items.where("kind = 'line'").select("file_id", "page", order.alias("ord"), "text", F.round("size", 1).alias("size"), "bold", "x0", "y0", "x1", "y1")


def _targets(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with target from their destination's name where they have no page; the first page of a name counts."""
    names = parts.where("kind = 'name'").groupBy("file_id", "name").agg(F.min("target").alias("_page"))
    return rows.join(names, ["file_id", "name"], "left").withColumn("target", F.coalesce("target", "_page")).drop("_page")


def chapters(parts: DataFrame, shown: DataFrame) -> DataFrame:
    """file_id, ord, level, title, page_start, page_end, parent_ord, source: the outline, or headings of files that have none."""
    totals = parts.where("kind = 'page'").groupBy("file_id").agg(F.max("page").alias("total_pages"))
    toc = _targets(parts.where("kind = 'toc'").select("file_id", "ord", "level", "title", "target", "name"), parts)
    toc = toc.select("file_id", F.col("ord").cast("long").alias("ord"), "level", "title", F.col("target").alias("page"), F.lit("outline").alias("source"))
    bare = totals.join(toc.select("file_id").distinct(), "file_id", "left_anti")
    found = detect_headings(shown, bare)
    detected = found.select("file_id", "ord", "level", F.col("text").alias("title"), "page", F.lit("heading_detect").alias("source"))
    entries = toc.unionByName(detected).where("page > 0").join(totals, "file_id")
    entries = entries.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("ord")) - 1)
    title = F.substring(strip(F.coalesce("title", F.lit(""))), 1, 1024)
    titled = entries.withColumn("title", F.when(title == "", F.concat(F.lit("(untitled "), F.col("ord"), F.lit(")"))).otherwise(title))
    return section_bounds(stored(titled, "pdf-outline")).select("file_id", "ord", "level", "title", F.col("page").alias("page_start"), "page_end", "parent_ord", "source")


def _chapter_of(pages: DataFrame, outline: DataFrame, page: str, name: str) -> DataFrame:
    """pages with the ord of the chapter that a page is in, by an as-of join of the distinct pages."""
    at = page_chapters(pages.select("file_id", F.col(page).alias("page")).distinct(), outline.withColumn("id", F.col("ord")))
    return pages.join(at.select("file_id", F.col("page").alias(page), F.col("chapter_id").alias(name)), ["file_id", page], "left")


def chunks(shown: DataFrame, outline: DataFrame) -> DataFrame:
    """file_id, page, ord, chapter_ord, text: the text of each page in windows, ord through the file."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    pages = shown.groupBy("file_id", "page").agg(text.alias("text")).withColumn("place", F.struct("file_id", "page"))
    cut = chunk_pages(pages, "place").select("place.*", F.col("ord").alias("piece"), "text")
    tagged = _chapter_of(cut, outline, "page", "chapter_ord")
    return tagged.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("page", "piece")) - 1).select("file_id", "page", "ord", "chapter_ord", "text")


def internal_links(parts: DataFrame, outline: DataFrame) -> DataFrame:
    """file_id, src_page, ord, dst_page, src_chapter, dst_chapter, target_label of links to a page of the same file.

    Links that leave the file, and those whose destination is not there, are dropped; a chapter is null before the first.
    """
    found = _targets(parts.where("kind = 'link'").select("file_id", F.col("page").alias("src_page"), "ord", "target", "name"), parts).where("target > 0")
    placed = _chapter_of(_chapter_of(found.withColumnRenamed("target", "dst_page"), outline, "src_page", "src_chapter"), outline, "dst_page", "dst_chapter")
    titles = outline.select("file_id", F.col("ord").alias("dst_chapter"), F.col("title").alias("target_label"))
    return placed.join(titles, ["file_id", "dst_chapter"], "left").select("file_id", "src_page", "ord", "dst_page", "src_chapter", "dst_chapter", "target_label")


def tables(items: DataFrame, aligned: bool = False) -> DataFrame:
    """file_id, page, ord, how, bbox, table_md of the tables; those that only gaps show if asked for."""
    found = items.where("kind = 'table'" if aligned else "kind = 'table' and text = 'ruled'")
    marked = found.withColumn("table_md", table_markdown(F.col("cells"))).where("table_md <> ''")
    return marked.select("file_id", "page", "ord", F.col("text").alias("how"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), "table_md")


def figures(parts: DataFrame, items: DataFrame, least: int = 64) -> DataFrame:
    """file_id, page, xref, width, height, format, bbox, data of the rasters: each once, on its first page, none smaller than least.

    bbox is where the page shows it first, null if only its resources name it.
    """
    images = best_figures(parts.where("kind = 'image'").select("file_id", F.col("number").alias("xref"), "page", "width", "height", "format", "data"), least)
    placed = items.where("kind = 'placed'").groupBy("file_id", "page", F.col("text").cast("long").alias("xref")).agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "ord").alias("bbox"))
    return images.join(placed, ["file_id", "page", "xref"], "left").select("file_id", "page", "xref", "width", "height", "format", "bbox", "data")


def errors(parts: DataFrame) -> DataFrame:
    """file_id, page, error of what could not be read; page is null if it is the whole file."""
    return parts.where("kind = 'error'").select("file_id", "page", "error")
