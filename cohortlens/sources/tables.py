"""Scans of uploaded tables: strict CSV and XLSX, a file to a task, as rows ``(path, sheet, row_number, values)``.

Row numbers are part of the results (rejects and external ids), so a file isn't split; uploads are of bounded size, which
is checked before parsing, and many files are read in parallel.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an upload.
UPLOAD_BYTES = 25 << 20
XLSX_ENTRIES, XLSX_BYTES, XLSX_RATIO = 200, 100 << 20, 100
COLUMNS, ROWS, CELLS = 512, 100_000, 2_000_000
SCHEMA = "path string, sheet string, row_number int, values array<string>, error string"


class Rejected(ValueError):
    """The file breaks a rule of its format."""


def csv_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Records, counted from 1 (the header); short rows are padded, long ones are an error."""
    if b"\0" in data:
        raise Rejected("NUL byte")
    try:
        reader = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)
        width = None
        for i, row in enumerate(reader, 1):
            width = len(row) if width is None else width
            if len(row) > width:
                raise Rejected(f"row {i} has {len(row)} values, the header has {width}")
            if row:
                yield "", i, row + [""] * (width - len(row))
    except (UnicodeDecodeError, csv.Error) as e:
        raise Rejected(str(e)) from e


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Rows of every sheet: shared and inline strings, gaps filled, blank rows skipped but counted."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        infos = book.infolist()
        if len(infos) > XLSX_ENTRIES or len({i.filename for i in infos}) < len(infos):
            raise Rejected("too many or doubled entries")
        total = sum(i.file_size for i in infos)
        if total > XLSX_BYTES or total > XLSX_RATIO * max(1, len(data)):
            raise Rejected("it expands too far")
        read = lambda name: ElementTree.fromstring(book.read(name))
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{ns['m']}}}t"))
        shared = [text(x) for x in read("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in book.namelist() else []
        targets = {x.get("Id"): x.get("Target").lstrip("/") for x in read("xl/_rels/workbook.xml.rels")}
        names, cells = set(), 0
        for sheet in read("xl/workbook.xml").find("m:sheets", ns):
            name, target = sheet.get("name"), targets[sheet.get(rel)]
            if name in names:
                raise Rejected(f"sheet {name!r} twice")
            names.add(name)
            found = []
            for at, row in enumerate(read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{ns['m']}}}row"), 1):
                values: list[str] = []
                for c in row.findall("m:c", ns):
                    i = _column(c.get("r", "A")) if c.get("r") else len(values)
                    value = c.find("m:v", ns)
                    raw = (value.text or "") if value is not None else ""
                    raw = shared[int(raw)] if c.get("t") == "s" and raw else text(c) if c.get("t") == "inlineStr" else raw
                    if i >= COLUMNS:
                        raise Rejected("too many columns")
                    values += [""] * (i + 1 - len(values))
                    values[i] = raw
                cells += len(values)
                number = int(row.get("r", at))
                if number > ROWS or cells > CELLS:
                    raise Rejected("too many rows or cells")
                found.append((number, values))
            width = max((len(v) for _, v in found), default=0)
            for number, values in found:
                if any(values):
                    yield name, number, values + [""] * (width - len(values))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, AttributeError, TypeError) as e:
        raise Rejected(f"{type(e).__name__}: {e}") from e


def scanned(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of all files at ``path``; a file that breaks a rule gives one row with its ``error`` and no other."""
    parse = {"csv": csv_rows, "xlsx": xlsx_rows}[kind]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, length, data in zip(frame["path"], frame["length"], frame["content"]):
                try:
                    if length > UPLOAD_BYTES:
                        raise Rejected("the file is too large")
                    found = [(name, s, i, v, None) for s, i, v in parse(data)]
                except Rejected as e:
                    found = [(name, None, None, None, str(e))]
                yield pd.DataFrame(found, columns=["path", "sheet", "row_number", "values", "error"]).astype({"row_number": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(rows, SCHEMA)


def with_headers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)``: the first row of each file and sheet, and the others as maps from header to value."""
    sound = rows.where("error is null")
    headers = sound.groupBy("path", "sheet").agg(F.min_by("values", "row_number").alias("headers"), F.min("row_number").alias("first"))
    body = sound.join(headers, ["path", "sheet"]).where("row_number > first")
    return headers.drop("first"), body.select(F.col("sheet").alias("source_partition"), "path", "row_number", F.map_from_arrays("headers", "values").alias("values"))
