"""Word-processor files by the standard library: blocks in body order, chapters, chunks and tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_heading, style_level, table_markdown

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "content_hash string, ord int, kind string, text string, style string, rows array<array<string>>"


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag == f"{_W}tab":
            parts.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
    return "".join(parts)


def blocks_of(data: bytes) -> list[dict]:
    """Paragraphs and tables of the body in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else None
            shown = names.get(key) or key
            # built-in heading names are stored in lower case
            out.append({"kind": "para", "text": _text(node), "style": re.sub(r"^heading", "Heading", shown) if shown else None, "rows": None})
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_text(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append({"kind": "table", "text": None, "style": None, "rows": rows})
    return out


def read_blocks(files: DataFrame) -> DataFrame:
    """content_hash, ord (from 1), kind, text, style, rows of all blocks of binary files (content_hash, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                blocks = blocks_of(row.content)
                yield pd.DataFrame([{"content_hash": row.content_hash, "ord": i, **b} for i, b in enumerate(blocks, 1)], columns=["content_hash", "ord", "kind", "text", "style", "rows"])

    return files.select("content_hash", "content").mapInPandas(run, BLOCKS)


def chapters(blocks: DataFrame) -> DataFrame:
    """Headings: by style where a file has heading styles, else short lines that read like headings at level 1."""
    text = F.trim("text")
    styled = style_level(F.col("style"))
    any_styled = F.max(styled.isNotNull() & (text != "")).over(Window.partitionBy("content_hash"))
    level = F.when(any_styled, styled).when(looks_like_heading(text, F.col("style")), 1)
    return blocks.where("kind = 'para'").withColumn("level", level).where(F.col("level").isNotNull() & (text != "")).select("content_hash", "ord", "level", text.alias("title"), F.lit("docx").alias("source"))


def tables(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'table'").select("content_hash", "ord", table_markdown(F.col("rows")).alias("table_md"))
