"""Named queries over uploaded files, which are written from the tables first (some with something wrong), each with its SQL."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.staging import new_path
from cohortlens.plans.queries import query
from cohortlens.plans.views import table
from cohortlens.sources import uploads
from cohortlens.sources.mapping import Mapping

MAPPING = Mapping("v1", {"mail": "Mail", "track": "Track"}, ["ID"], ["mail"], headers=["ID", "Mail", "Track"], external_id="ID", identity="mail")


def csv_bytes(rows: list[list[str]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def xlsx_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of inline strings."""
    main, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} {r}><sheets>{''.join(f'<sheet name={quoteattr(s)} r:id="r{i}"/>' for i, s in enumerate(sheets))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{"".join(f"<Relationship Id={quoteattr(f"r{i}")} Target={quoteattr(f"worksheets/s{i}.xml")}/>" for i in range(len(sheets)))}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            cells = lambda row: "".join(f'<c t="inlineStr" r="{chr(65 + j)}1"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(row))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{''.join(f'<row>{cells(row)}</row>' for row in rows)}</sheetData></worksheet>")
    return out.getvalue()


def written(rows: DataFrame, by: str, suffix: str, made: Callable[[int, pd.DataFrame], bytes]) -> str:
    """A folder with a file for each value of ``by`` (of few rows each); a task that runs again writes the same bytes again."""
    folder = new_path(rows.sparkSession, "upload-files")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame[by].iloc[0])
        files, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base)
        with files.open_output_stream(f"{base}/{n}.{suffix}") as f:
            f.write(made(n, frame))
        return pd.DataFrame({"n": [n]})

    rows.groupBy(by).applyInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    return folder.removeprefix("file://").removeprefix("file:")


def _file() -> F.Column:
    return F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("file")


@query("""WITH o AS (SELECT o_orderkey // 256 AS file, o_orderkey, 1 + row_number() OVER (PARTITION BY o_orderkey // 256 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT file, count(*) AS n, min(i) FILTER (o_orderkey % 32 = 5) AS short FROM o GROUP BY 1)
 SELECT file, CASE WHEN e IS NULL THEN n ELSE 0 END AS n_rows, e AS error FROM (SELECT *, CASE file % 5 WHEN 1 THEN 'the table: unexpected columns' WHEN 2 THEN 'the table: row ' || short || ' has 2 values; expected 3' WHEN 3 THEN 'NUL byte' WHEN 4 THEN 'no data rows' END AS e FROM f)""")
def upload_preflight(spark, d):
    """CSV files of orders: with columns in another order, a short record, a NUL byte, or without rows."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), "o_orderstatus", F.expr("o_orderkey div 256").alias("file"))

    def made(n: int, frame: pd.DataFrame) -> bytes:
        header = ["key", "status", "customer"] if n % 5 == 1 else ["key", "customer", "status"]
        body = [[str(k), c, f'{s}, "{s}"\nnext'][: 2 if n % 5 == 2 and k % 32 == 5 else 3] for k, c, s in sorted(zip(frame["o_orderkey"], frame["c"], frame["o_orderstatus"]))]
        return csv_bytes([header] + ([] if n % 5 == 4 else body)) + (b"\0" if n % 5 == 3 else b"")

    found = uploads.preflight(spark, written(rows, "file", "csv", made), "csv", "single_table", ["key", "customer", "status"])
    return found.select(_file(), "n_rows", "error")


def _results(spark, folder: str, adapter: str, role: str, source_type: str, sheets: list[str] | None) -> DataFrame:
    """Mapped rows, rejects and problems, one under the other."""
    mapping = Mapping(**{**vars(MAPPING), "source_type": source_type})
    good, rejects, problems = uploads.registered(spark, folder, adapter, role, mapping, sheets)
    columns = "file", "source_partition", "row_number", "external_record_id", "applicant_identity", "track", "problem"
    parts = good, rejects.withColumnRenamed("reject_code", "problem"), problems.withColumnRenamed("error", "problem")
    padded = [p.select(_file(), *[F.col(c) if c in p.columns else F.lit(None).cast("int" if c == "row_number" else "string").alias(c) for c in columns[1:]]) for p in parts]
    return padded[0].unionByName(padded[1]).unionByName(padded[2])


#: Orders as rows of sheets, with blank identities and blank rows; the second sheet holds the odd keys.
_SHEETS_SQL = """o AS (SELECT o_orderkey // 256 AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS sheet, o_orderkey AS k, o_custkey AS c, CAST(1 + row_number() OVER (PARTITION BY o_orderkey // 256, o_orderkey % 2 ORDER BY o_orderkey) AS INTEGER) AS i FROM orders),
 good AS (SELECT file, sheet AS source_partition, i AS row_number, CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN k || 'x' END AS external_record_id, CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN 'm' || c || '@x.test' END AS applicant_identity, CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN 't' || c % 3 END AS track,
  CASE WHEN k % 5 = 0 THEN 'missing_source_identity' WHEN k % 7 = 0 THEN 'missing_applicant_identity' END AS problem FROM o WHERE k % 11 > 0)"""


def _books(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.expr("o_orderkey div 256").alias("file"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def _body(frame: pd.DataFrame, odd: int) -> list[list[str]]:
    """Rows of a sheet: every 11th blank, every 5th without an id, every 7th without an address."""
    pairs = sorted((k, c) for k, c in zip(frame["k"], frame["c"]) if k % 2 == odd)
    return [["", "", ""] if k % 11 == 0 else [f" {k}x " if k % 5 else " ", f"M{c}@X.test" if k % 7 else "", f"t{c % 3}"] for k, c in pairs]


@query(f"""WITH {_SHEETS_SQL}, e AS (SELECT DISTINCT file, CASE WHEN file % 4 = 1 THEN 'B: unexpected: Extra; missing: Track' WHEN file % 4 = 2 THEN 'sheets are missing: B' END AS problem FROM o)
 SELECT good.* FROM good WHERE file % 4 NOT IN (1, 2) UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, problem FROM e WHERE problem IS NOT NULL""")
def upload_sheets(spark, d):
    """Workbooks with a header for each sheet (columns in another order on the second), some with another header or without a sheet."""

    def made(n: int, frame: pd.DataFrame) -> bytes:
        sheets = {"notes": [["free", "text"]], "A": [["ID", "Mail", "Track"], *_body(frame, 0)], "B": [["Extra" if n % 4 == 1 else "Track", "ID", "Mail"], *[[t, i, m] for i, m, t in _body(frame, 1)]]}
        return xlsx_bytes({s: rows for s, rows in sheets.items() if s != "B" or n % 4 != 2})

    return _results(spark, written(_books(spark, d), "file", "xlsx", made), "track-preferences-xlsx-v1", "preferences", "track_preferences", ["A", "B"])


@query(f"""WITH {_SHEETS_SQL}, s AS (SELECT file, min(i) FILTER (sheet = 'B' AND k % 11 > 0) AS first FROM o GROUP BY 1)
 SELECT good.* FROM good WHERE file % 3 > 0 UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, 'B: row ' || first || ' has 4 values; expected 3' FROM s WHERE file % 3 = 0""")
def upload_shared_header(spark, d):
    """Workbooks whose second sheet repeats the first one's header or has none, and some with a value too many there."""

    def made(n: int, frame: pd.DataFrame) -> bytes:
        header = ["ID", "Mail", "Track"]
        more = [row + (["z"] if n % 3 == 0 and any(row) else []) for row in _body(frame, 1)]
        return xlsx_bytes({"A": [header, *_body(frame, 0)], "B": ([header] if n % 2 == 0 else []) + more})

    return _results(spark, written(_books(spark, d), "file", "xlsx", made), "devpost-final-xlsx-v1", "submissions", "devpost_final", ["A", "B"])
