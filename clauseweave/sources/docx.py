"""DOCX source: one row per file with its ordered paragraph and table blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCK

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# Characters a run element other than text stands for.
_RUN_TEXT = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-", "ptab": "\t"}


def _collapse(text: str) -> str:
    return " ".join(text.split())


def _run_text(run: ElementTree.Element) -> str:
    out = []
    for part in run:
        name = part.tag.removeprefix(_W)
        if name == "t":
            out.append(part.text or "")
        elif name == "br" and part.get(f"{_W}type", "textWrapping") != "textWrapping":
            continue  # page and column breaks carry no text
        else:
            out.append(_RUN_TEXT.get(name, ""))
    return "".join(out)


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    runs = []
    for part in paragraph:
        if part.tag == f"{_W}r":
            runs.append(_run_text(part))
        elif part.tag == f"{_W}hyperlink":
            runs.extend(_run_text(run) for run in part.findall(f"{_W}r"))
    return "".join(runs)


def _table_text(table: ElementTree.Element) -> str:
    """Rows of " | "-joined cells; merged cells repeat, empty rows vanish."""
    rows, above = [], {}
    for row in table.findall(f"{_W}tr"):
        cells, column = [], 0
        for cell in row.findall(f"{_W}tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            width = int(span.get(f"{_W}val", "1")) if span is not None else 1
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            continued = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
            if continued and column in above:
                text = above[column]
            else:
                text = _collapse("\n".join(_paragraph_text(p) for p in cell.findall(f"{_W}p")))
            above[column] = text
            cells.extend([text] * width)
            column += width
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def parse_docx(content: bytes) -> list[dict]:
    """Blocks of one document in body order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names, default = {}, "Normal"
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).findall(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is None or style.get(f"{_W}type", "paragraph") != "paragraph":
                    continue
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "")
                if style.get(f"{_W}default") in {"1", "true", "on"}:
                    default = name.get(f"{_W}val", "")
    blocks = []
    for element in body if body is not None else ():
        if element.tag == f"{_W}p":
            style = element.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(f"{_W}val"), default) if style is not None else default
            raw = _paragraph_text(element)
            blocks.append({"kind": "paragraph", "text": _collapse(raw), "style": name, "raw": raw})
        elif element.tag == f"{_W}tbl":
            text = _table_text(element)
            blocks.append({"kind": "table", "text": text, "style": "Table", "raw": text})
    return blocks


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc, source_file, sha256, blocks) per DOCX file; files are read in parallel."""

    @F.pandas_udf(f"array<{BLOCK.simpleString()}>")
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([parse_docx(bytes(c)) for c in contents])

    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("doc"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.sha2("content", 256).alias("sha256"),
        blocks("content").alias("blocks"),
    )
