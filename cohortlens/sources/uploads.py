"""Uploaded tables as a registered source: ``spark.read.format("upload_tables")``, and preflight and mapping on top of it.

Rows are ``(path, sha256, source_partition, row_number, values, error)``: one for each data row, ``values`` a map from header to
text. A file that breaks a rule gives one row with its ``error`` and no other, so that nothing of it is taken. Row numbers count
records after the header from 2, blank ones too; blank rows give no row. Files are dealt to tasks by size; a file is read as a stream
(a ZIP's directory first, then one sheet after another, an XML element at a time), once to check it and once for its rows, and
what a task holds is one row, and the shared strings of a workbook (bounded by the limits below).

Options: ``kind`` (csv, xlsx), ``layout`` (single_table, header_per_sheet, shared_first_header: later sheets may omit or repeat the
first one's header), ``sheets`` (JSON list, all by default; each must be there), ``headers`` (JSON list) with ``rule`` (mapping: any
order; exact: this very order, and every record of a CSV must be as wide), ``columns`` (JSON list: no other is put into ``values``).

Empty files, files without a data row and folders without a file are an error, an error and no rows; very long values are bounded by
the limits of a CSV field (131,072 code points) and of a file; repeated rows stay; doubled headers are an error where headers are
given, else the last value counts.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import BinaryIO
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortlens.operators.staging import stored
from cohortlens.sources.mapping import BadMapping, Mapping, authority_of, coded, drift, parted
from cohortlens.sources.tables import CELLS, COLUMNS, ROWS, UPLOAD_BYTES, XLSX_BYTES, XLSX_ENTRIES, XLSX_RATIO, Rejected

FORMAT = "upload_tables"
SCHEMA = "path string, sha256 string, source_partition string, row_number int, values map<string,string>, error string"
#: Files of a task are at most so many bytes together, or one file.
TASK_BYTES = 32 << 20
# Adapters of registered sources, as (roles, kind, source types, layout, authority).
ADAPTERS = {
    "luma-csv-v2": (("applications",), "csv", ("luma_guests",), "single_table", None),
    "luma-supplement-csv-v1": (("attendance",), "csv", ("luma_supplement",), "single_table", "luma_final_status_supplement"),
    "track-preferences-xlsx-v1": (("preferences",), "xlsx", ("track_preferences",), "header_per_sheet", None),
    "devpost-final-xlsx-v1": (("submissions",), "xlsx", ("devpost_final",), "shared_first_header", None),
    "mapped-xlsx-v1": (("applications", "attendance"), "xlsx", ("luma_guests", "luma_supplement"), "header_per_sheet", "luma_final_status_supplement"),
}
ROLE_TYPES = {
    "applications": ("luma_guests",), "attendance": ("luma_supplement",), "preferences": ("track_preferences",),
    "teams": ("devpost_registrants",), "submissions": ("devpost_final", "devpost_projects"),
}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
Table = tuple[str | None, Iterator[list[str]]]


def _lines(text: io.TextIOBase) -> Iterator[str]:
    for line in text:
        if "\0" in line:
            raise Rejected("NUL byte")
        yield line


def csv_tables(stream: BinaryIO) -> Iterator[Table]:
    text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
    yield None, csv.reader(_lines(text))
    text.detach()


def _elements(stream: BinaryIO, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name; what has been read is forgotten."""
    path = []
    for event, node in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if node.tag == _MAIN + name:
            yield node
        if path and not any(p.tag == _MAIN + name for p in path):
            path[-1].remove(node)


def _position(reference: str) -> int | None:
    letters = re.match("[A-Z]+", reference)
    n = 0
    for ch in letters[0] if letters else "":
        n = n * 26 + ord(ch) - 64
    return n or None


def _width(stream: BinaryIO) -> int:
    """The columns that a sheet's dimension names, 0 where it names none."""
    for _, node in ElementTree.iterparse(stream, events=("start",)):
        if node.tag == _MAIN + "sheetData":
            break
        end = re.fullmatch("([A-Z]+)([0-9]+)", node.get("ref", "A1").split(":")[-1]) if node.tag == _MAIN + "dimension" else None
        if end:
            columns, rows = _position(end[1]), int(end[2])
            if columns > COLUMNS or rows > ROWS or columns * rows > CELLS:
                raise Rejected("the sheet's dimensions are too large")
            return columns
    return 0


def _sheet_rows(book: zipfile.ZipFile, member: str, shared: list[str], counted: list[int]) -> Iterator[list[str]]:
    with book.open(member) as stream:
        width = _width(stream)
    with book.open(member) as stream:
        for number, row in enumerate(_elements(stream, "row")):
            if number >= ROWS:
                raise Rejected("too many rows")
            values: list[str] = []
            for cell in row.findall(_MAIN + "c"):
                counted[0] += 1
                column = _position(cell.get("r", "A1")) or len(values) + 1
                if counted[0] > CELLS or column > COLUMNS:
                    raise Rejected("too many cells or columns")
                inline, value = cell.find(_MAIN + "is"), cell.find(_MAIN + "v")
                text = "".join(inline.itertext()) if inline is not None else (value.text or "") if value is not None else ""
                values += [""] * (column - len(values) - 1)
                values.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            yield values + [""] * (width - len(values))


def xlsx_tables(stream: BinaryIO, wanted: list[str] | None) -> Iterator[Table]:
    """The sheets in the order of ``wanted``, or of the workbook."""
    with zipfile.ZipFile(stream) as book:
        infos = book.infolist()
        names = [i.filename for i in infos]
        total, packed = sum(i.file_size for i in infos), sum(max(1, i.compress_size) for i in infos)
        if len(infos) > XLSX_ENTRIES or len(set(names)) < len(names):
            raise Rejected("too many or doubled entries")
        if total > XLSX_BYTES or total > XLSX_RATIO * packed:
            raise Rejected("it expands too far")
        relations = list(ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")))
        targets = {x.attrib["Id"]: x.attrib["Target"] for x in relations}
        sheets = [(x.attrib["name"], x.attrib[_REL]) for x in ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f".//{_MAIN}sheets/{_MAIN}sheet")]
        if len(targets) < len(relations) or len(dict(sheets)) < len(sheets):
            raise Rejected("a sheet or a relationship stands twice")
        wanted = [s for s, _ in sheets] if wanted is None else wanted
        missing = [s for s in wanted if s not in dict(sheets)]
        if missing:
            raise Rejected(f"sheets are missing: {', '.join(missing)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as strings:
                shared = ["".join(x.itertext()) for x in _elements(strings, "si")]
        counted = [0]
        for sheet in wanted:
            target = targets[dict(sheets)[sheet]]
            member = target if target.startswith("xl/") else f"xl/{target.lstrip('/')}"
            if not member.startswith("xl/worksheets/") or ".." in member.split("/"):
                raise Rejected("a sheet lies outside the worksheets")
            yield sheet, _sheet_rows(book, member, shared, counted)


def table_rows(stream: BinaryIO, options: dict) -> Iterator[tuple[str | None, int, dict[str, str]]]:
    """``(sheet, row number, values)`` of a file's data rows under a layout; raises ``Rejected`` at the first rule that is broken."""
    try:
        yield from _table_rows(stream, options)
    except Rejected:
        raise
    except UnicodeDecodeError as e:
        raise Rejected("not UTF-8") from e
    except (csv.Error, zipfile.BadZipFile, ElementTree.ParseError, LookupError, ValueError) as e:
        raise Rejected(f"malformed: {type(e).__name__}") from e


def _table_rows(stream: BinaryIO, options: dict) -> Iterator[tuple[str | None, int, dict[str, str]]]:
    layout, wanted, rule = options["layout"], options["headers"], options["rule"]
    whole = options["kind"] == "csv" and rule == "exact"
    header: list[str] = []
    count = 0
    for at, (sheet, rows) in enumerate(csv_tables(stream) if options["kind"] == "csv" else xlsx_tables(stream, options["sheets"])):
        name = sheet or "the table"
        first = next(rows, None)
        repeated = layout == "shared_first_header" and at > 0
        if not repeated:
            if first is None:
                raise Rejected(f"{name} has no header row")
            header, first = first, None
            problem = "" if wanted is None else drift(header, wanted) if rule == "mapping" else "unexpected columns" if header != wanted else ""
            if problem:
                raise Rejected(f"{name}: {problem}")
        elif first == header:
            first = None
        kept = [(i, h) for i, h in enumerate(header) if options["columns"] is None or h in options["columns"]]
        number = 1
        for values in [first] if first is not None else []:
            number += 1
            yield from _taken(name, sheet, number, values, header, kept, whole)
            count += any(values) or whole
        for values in rows:
            number += 1
            yield from _taken(name, sheet, number, values, header, kept, whole)
            count += any(values) or whole
    if not count:
        raise Rejected("no data rows")


def _taken(name: str, sheet: str | None, number: int, values: list[str], header: list[str], kept: list[tuple[int, str]], whole: bool) -> Iterator[tuple]:
    if whole or any(values):
        if len(values) != len(header):
            raise Rejected(f"{name}: row {number} has {len(values)} values; expected {len(header)}")
        yield sheet, number, {h: values[i] for i, h in kept}


class UploadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        # A scheme names a file system; a path without one is a local or mounted one.
        self.files, self.path = fs.FileSystem.from_uri(options["path"]) if re.match("[a-z][a-z0-9+.-]*:", options["path"]) else (fs.LocalFileSystem(), options["path"])

    def partitions(self) -> list[InputPartition]:
        """Files of one folder (its pattern's, or all below it), next to each other by name, in tasks of bounded bytes."""
        folder, _, pattern = self.path.rpartition("/")
        if self.files.get_file_info(self.path).type == fs.FileType.Directory:
            found = self.files.get_file_info(fs.FileSelector(self.path, recursive=True))
        else:
            found = [i for i in self.files.get_file_info(fs.FileSelector(folder)) if fnmatch(i.base_name, pattern)]
        tasks: list[list[tuple[str, int]]] = []
        room = 0
        for info in sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            if not tasks or info.size > room:
                tasks.append([])
                room = TASK_BYTES
            tasks[-1].append((info.path, info.size))
            room -= info.size
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, size in partition.value if partition else []:
            digest = None
            try:
                if size > UPLOAD_BYTES:
                    raise Rejected("the file is too large")
                with self.files.open_input_file(path) as f:
                    digest = hashlib.file_digest(f, "sha256").hexdigest()
                for _ in self._rows(path):
                    pass
            except Rejected as e:
                yield path, digest, None, None, None, str(e)
                continue
            for sheet, number, values in self._rows(path):
                yield path, digest, sheet, number, values, None

    def _rows(self, path: str) -> Iterator[tuple]:
        with self.files.open_input_file(path) as f:
            yield from table_rows(f, self.options)


class UploadTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadReader:
        listed = {k: json.loads(self.options[k]) if k in self.options else None for k in ("sheets", "headers", "columns")}
        return UploadReader({"path": self.options["path"], "kind": self.options.get("kind", "csv"), "layout": self.options.get("layout", "single_table"), "rule": self.options.get("rule", "mapping")} | listed)


def read(spark: SparkSession, path: str, kind: str, layout: str = "single_table", rule: str = "mapping", **lists: list[str] | None) -> DataFrame:
    """The rows of the files at ``path`` (a file, a folder, or a pattern in the last place); ``lists``: sheets, headers, columns."""
    spark.dataSource.register(UploadTables)
    given = {k: json.dumps(v) for k, v in lists.items() if v is not None}
    return spark.read.format(FORMAT).options(kind=kind, layout=layout, rule=rule, **given).load(path)


def preflight(spark: SparkSession, path: str, kind: str, layout: str, headers: list[str], sheets: list[str] | None = None) -> DataFrame:
    """``(path, sha256, n_rows, error)``: each file against its exact headers; the digest of a file that is too large is null."""
    found = read(spark, path, kind, layout, "exact", sheets=sheets, headers=headers, columns=[])
    return found.groupBy("path", "sha256").agg(F.count("row_number").alias("n_rows"), F.max("error").alias("error"))


def adapter_of(adapter: str, role: str, mapping: Mapping, sheets: list[str] | None) -> tuple[str, str, str | None]:
    """``(kind, layout, authority)`` of a registered adapter, where role, mapping and sheets agree with it."""
    if adapter not in ADAPTERS:
        raise BadMapping(f"no adapter reads {adapter}")
    roles, kind, types, layout, authority = ADAPTERS[adapter]
    if role not in roles or mapping.source_type not in types or mapping.source_type not in ROLE_TYPES[role]:
        raise BadMapping(f"{adapter} does not read {mapping.source_type} as {role}")
    if bool(sheets) != (kind == "xlsx"):
        raise BadMapping("a workbook's sheets must be named, another source has none")
    return kind, layout, authority_of(mapping, authority if mapping.needs_authority else None)


def registered(spark: SparkSession, path: str, adapter: str, role: str, mapping: Mapping, sheets: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(mapped, rejects, problems)`` of the files of a role; a file with a problem (one of its rules, or no row that can be mapped) gives no mapped row.

    The files are parsed once, into a table of the shared folder, which the three results read.
    """
    kind, layout, authority = adapter_of(adapter, role, mapping, sheets)
    rows = stored(read(spark, path, kind, layout, sheets=sheets, headers=mapping.wanted()), "uploads")
    keep = ("path", "sha256")
    good, rejects = parted(coded(rows.where("error is null"), mapping, keep), keep)
    counted = coded(rows.where("error is null"), mapping, keep).groupBy(*keep).agg(F.count_if(F.col("reject_code").isNull()).alias("n"))
    problems = rows.where("error is not null").select(*keep, "error").unionByName(counted.where("n = 0").select(*keep, F.lit("no valid mapped rows").alias("error")))
    return good.withColumn("authority", F.lit(authority)), rejects, problems
