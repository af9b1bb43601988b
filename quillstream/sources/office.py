"""Spreadsheets and word documents (ZIP packages of XML) as rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What a file may raise whose package, XML, references or compressed parts are broken.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, LookupError, TypeError, ValueError, AttributeError, EOFError, NotImplementedError, RuntimeError, zlib.error)
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    """Number of the column of a cell such as BC12, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of the filled cells of a workbook; formulas count with their last value."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = links[sheet.get(LINK)].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for cell in ElementTree.fromstring(z.read(path)).iter(f"{MAIN}c"):
                kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else (value.text if value is not None else None)
                if text is None or text == "":
                    continue
                text = shared[int(text)] if kind == "s" else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
                place = cell.get("r")
                yield sheet.get("name"), int(re.search(r"\d+", place)[0]) - 1, _column(place), text


def word_blocks(raw: bytes) -> Iterator[tuple[int, str, str]]:
    """(place, type, text) of the paragraphs and tables of a word document: heading, list_item, paragraph or table."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    place = 0
    for part in body:
        if part.tag == f"{WORD}p":
            text = "".join(t.text or "" for t in part.iter(f"{WORD}t")).strip()
            style = next((s.get(f"{WORD}val", "") for s in part.iter(f"{WORD}pStyle")), "").lower()
            kind = "heading" if "heading" in style or "title" in style else "list_item" if "list" in style else "paragraph"
        elif part.tag == f"{WORD}tbl":
            rows = [[" ".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in c.iter(f"{WORD}p")).strip() for c in r.iter(f"{WORD}tc")] for r in part.iter(f"{WORD}tr")]
            text, kind = "\n".join(" | ".join(r) for r in rows), "table"
        else:
            continue
        if text:
            yield place, kind, text
            place += 1


def _each(files: DataFrame, read, columns: list[str], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in read(bytes(raw))]
                except BROKEN as x:  # one broken file doesn't stop the others
                    rows = [(path, *[None] * len(columns), f"{type(x).__name__}: {x}"[:200])]
                yield pd.DataFrame(rows, columns=["path", *columns, "error_message"])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error_message string")


def spreadsheet_cells(files: DataFrame) -> DataFrame:
    """path, sheet, row_idx, col_idx, value, error_message of workbooks (path, content)."""
    return _each(files, sheet_cells, ["sheet", "row_idx", "col_idx", "value"], "sheet string, row_idx int, col_idx int, value string")


def document_blocks(files: DataFrame) -> DataFrame:
    """path, reading_order, type, text, error_message of word documents (path, content)."""
    return _each(files, word_blocks, ["reading_order", "type", "text"], "reading_order int, type string, text string")
