"""Workbook exports (XLSX): the active sheet's cells as text with their kind, with header detection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.exports import header_row

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = pa.schema([("_file", pa.string()), ("_row_ord", pa.int64()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("native", pa.list_(pa.bool_()))])


def _column(reference: str) -> int:
    """A1 is column 0, AA1 column 26."""
    n = 0
    for ch in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _active_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    wanted = sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(_LINK)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(content: bytes) -> Iterator[list[tuple[str | None, bool]]]:
    """Rows of the active sheet, one (text, native number) a cell; gaps are (None, False); formulas give their cached value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with book.open(_active_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[tuple[str | None, bool]] = []
                for c in row.findall(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [(None, False)] * (at - len(cells))
                    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells.append(("".join(t.text or "" for t in c.iter(f"{_MAIN}t")), False))
                    elif v is None or v.text is None:
                        cells.append((None, False))
                    else:
                        cells.append((shared[int(v.text)] if kind == "s" else v.text, kind == "n"))
                yield cells
                row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Every workbook at path, one a task step on the executors: _file, _row_ord, header, cells, native (arrays).

    native tells which cells were numbers, such as dates that the sheet keeps as serials. The header row and what
    precedes it are no rows; short rows keep their length; an empty sheet has no rows. Read through Spark, any store.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sheet_rows(content)
                head = [row for _, row in zip(range(10), found)]
                at = header_row([[text for text, _ in row] for row in head])
                header = [(text or "").strip() for text, _ in head[at]] if head else []
                part: list[dict] = []
                for k, row in enumerate(x for rest in (head[at + 1 :], found) for x in rest):
                    row = row[: len(header)]
                    part.append({"_file": name, "_row_ord": k, "header": header, "cells": [t for t, _ in row], "native": [n for _, n in row]})
                    if len(part) == 4096:
                        yield pa.RecordBatch.from_pylist(part, _ROWS)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, _ROWS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "_file string, _row_ord long, header array<string>, cells array<string>, native array<boolean>")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """CSV or XLSX by the suffix, in any case; another suffix is an error when the plan is made."""
    from tallyfold.sources.exports import read_csv

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "xlsx"):
        raise ValueError(f"unsupported file type: {path!r}")
    return read_csv(spark, path) if suffix == "csv" else read_xlsx(spark, path)
