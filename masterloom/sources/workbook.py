"""Landing XLSX workbooks: the first sheet of each, one workbook per task.

A sheet holds at most 1,048,576 rows by its format, so a workbook is a bounded
unit of work. Ordinals follow the file names, then the rows of each sheet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import written
from .landing import with_row_index
from .schemas import CURATED_HEADERS, DATE_HEADERS

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BATCH = 5_000


def _column(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        index = index * 26 + ord(letter) - 64
    return index - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_NS + "t"))


def _cells(row, shared: list[str]) -> dict[int, str]:
    values = {}
    for cell in row.iter(_NS + "c"):
        kind, value = cell.get("t"), cell.find(_NS + "v")
        if kind == "inlineStr":
            text = _text(cell)
        elif value is None or value.text is None:
            continue
        else:
            text = shared[int(value.text)] if kind == "s" else value.text
        values[_column(cell.get("r"))] = text
    return values


def _first_sheet(book: zipfile.ZipFile, names: list[str]) -> str:
    """File of the first tab: the workbook lists tabs, its relations their files.
    A book without that list has its sheets in the order of their numbers."""
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        tab = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
        wanted = None if tab is None else tab.get(_REL + "id")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if link.get("Id") == wanted:
                target = link.get("Target")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = [n for n in names if n.startswith("xl/worksheets/sheet")]
    return min(sheets, key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Cells of every row of the first sheet, blank rows included."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_NS + "si")]
        with book.open(_first_sheet(book, names)) as stream:
            done = 0
            for _, node in ElementTree.iterparse(stream):
                if node.tag == _NS + "row":
                    # A sheet may leave blank rows out; they count all the same.
                    number = int(node.get("r", done + 1))
                    yield from ({} for _ in range(done + 1, number))
                    yield _cells(node, shared)
                    done = number
                    node.clear()


def _date(text: str | None) -> str | None:
    """A day serial becomes an ISO date; other texts pass."""
    if text is None or not re.fullmatch(r"\d+(\.\d+)?", text):
        return text
    return (date(1899, 12, 30) + timedelta(days=int(float(text)))).isoformat()


def _read_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [*CURATED_HEADERS.values(), "_land_file", "_land_block", "_land_id"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _sheet_rows(content)
            head = next(rows, {})  # an empty sheet has no rows to give
            place = {text.strip(): index for index, text in head.items()}
            out = []
            for number, cells in enumerate(rows):
                values = [cells.get(place.get(h, -1)) for h in CURATED_HEADERS]
                values = [None if v in fv.MISSING_TOKENS else v for v in values]
                values = [_date(v) if h in DATE_HEADERS else v for h, v in zip(CURATED_HEADERS, values)]
                out.append((*values, path, 0, number))
                if len(out) == _BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Curated rows of every workbook under ``path``."""
    fields = ", ".join(f"`{name}` string" for name in CURATED_HEADERS.values())
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    # Workbooks are few and heavy: give each a task of its own.
    books = books.repartition(max(1, len(books.inputFiles())), F.col("path"))
    rows = books.mapInPandas(_read_books, f"{fields}, _land_file string, _land_block long, _land_id long")
    return with_row_index(written(rows, "workbooks"))
