"""Uploads as a registered source, mapping files and adapters, by hand-worked cases."""

import hashlib
import io
import json
import zipfile

import pytest

from cohortlens.plans.upload_queries import csv_bytes, xlsx_bytes
from cohortlens.sources import mapping, uploads

HEADERS = ["ID", "Mail"]
RAW = {
    "source_type": "luma_guests", "version": "v1", "expected_headers": ["ID", "Mail", "Note"], "field_map": {"mail": "Mail"}, "source_identity": {"fields": ["ID"], "mode": "all"},
    "applicant_identity": {"fields": ["mail"]}, "external_id_field": "ID", "applicant_identity_field": "mail", "metadata": {},
}


def rows(data, kind="csv", layout="single_table", rule="mapping", **lists):
    """Data rows of a file, or the rule that it breaks."""
    options = {"kind": kind, "layout": layout, "rule": rule, "sheets": None, "headers": None, "columns": None} | lists
    try:
        return [(s, n, list(v.values())) for s, n, v in uploads.table_rows(io.BytesIO(data), options)]
    except uploads.Rejected as e:
        return str(e)


def test_csv_files():
    assert rows(csv_bytes([HEADERS, ["1", "a\nb"], ["", ""], [], ["2", ""]])) == [(None, 2, ["1", "a\nb"]), (None, 5, ["2", ""])]
    assert rows(csv_bytes([HEADERS, ["1"]])) == "the table: row 2 has 1 values; expected 2"
    assert rows(csv_bytes([HEADERS, []]), rule="exact", headers=HEADERS) == "the table: row 2 has 0 values; expected 2"
    assert len(rows(csv_bytes([HEADERS, ["", ""]]), rule="exact", headers=HEADERS)) == 1
    assert rows(csv_bytes([HEADERS, ["", ""]])) == rows(csv_bytes([HEADERS])) == "no data rows"
    assert rows(b"") == "the table has no header row"
    assert rows(b"ID,Mail\n1,a\0\n") == "NUL byte"
    assert rows(csv_bytes([["Mail", "ID"], ["a", "1"]]), headers=HEADERS) == [(None, 2, ["a", "1"])]
    assert rows(csv_bytes([["Mail", "ID"], ["a", "1"]]), headers=HEADERS, rule="exact") == "the table: unexpected columns"
    assert rows(csv_bytes([["ID", "ID", "X"], ["a", "1", ""]]), headers=HEADERS) == "the table: unexpected: X; missing: Mail; duplicate: ID"
    assert rows(csv_bytes([HEADERS, ["1", "a"]]), columns=["Mail"]) == [(None, 2, ["a"])]


def test_layouts_of_workbooks():
    book = xlsx_bytes({"A": [HEADERS, ["1", "a"]], "B": [["2", "b"], ["", ""], ["3", "c"]], "C": [HEADERS, ["4", "d"]], "D": []})
    shared = lambda *s: rows(book, "xlsx", "shared_first_header", sheets=list(s))
    assert shared("A", "B", "C", "D") == [("A", 2, ["1", "a"]), ("B", 2, ["2", "b"]), ("B", 4, ["3", "c"]), ("C", 2, ["4", "d"])]
    assert shared("D", "A") == "D has no header row" and shared("A", "X") == "sheets are missing: X"
    assert rows(book, "xlsx", "header_per_sheet", sheets=["C", "A"]) == [("C", 2, ["4", "d"]), ("A", 2, ["1", "a"])]
    assert rows(book, "xlsx", "header_per_sheet", sheets=["A", "D"]) == "D has no header row"


def changed(book, members):
    """A workbook with members replaced or added."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name, data in ({n: old.read(n) for n in old.namelist()} | members).items():
            new.writestr(name, data)
    return out.getvalue()


def test_cells_and_limits_of_workbooks():
    book, main = xlsx_bytes({"A": [["x"]]}), uploads._MAIN[1:-1]
    sheet = lambda body, dimension="": changed(book, {"xl/worksheets/s0.xml": f'<worksheet xmlns="{main}">{dimension}<sheetData>{body}</sheetData></worksheet>'})
    head = '<row><c t="inlineStr"><is><t>a</t></is></c><c r="B1"><v>b</v></c><c r="C1"><v>c</v></c></row>'
    read = lambda data: rows(data, "xlsx", "header_per_sheet")
    # A gap is filled; a row is as wide as the dimension says.
    assert read(sheet(head + '<row><c r="B2"><v>7</v></c></row>', '<dimension ref="A1:C2"/>')) == [("A", 2, ["", "7", ""])]
    assert read(sheet(head + '<row><c r="B2"><v>7</v></c></row>')) == "A: row 2 has 2 values; expected 3"
    assert read(sheet(head, '<dimension ref="A1:SS2"/>')) == "the sheet's dimensions are too large"
    assert read(sheet('<row><c r="SS1"><v>1</v></c></row>')) == "too many cells or columns"
    assert read(sheet('<row><c t="s"><v>4</v></c></row>')) == "malformed: IndexError"
    assert read(sheet("<row>")) == "malformed: ParseError"
    bomb = sheet(head + "<row/>" * 200_000)
    assert read(bomb) == "it expands too far"
    many = changed(book, {f"x/{i}": "" for i in range(200)})
    assert read(many) == "too many or doubled entries"
    twice = zipfile.ZipFile(io.BytesIO(book)).read("xl/workbook.xml").replace(b"</sheets>", b'<sheet name="A" r:id="r1"/></sheets>')
    assert read(changed(book, {"xl/workbook.xml": twice})) == "a sheet or a relationship stands twice"
    outside = '<Relationships><Relationship Id="r0" Target="../other.xml"/></Relationships>'
    assert read(changed(book, {"xl/_rels/workbook.xml.rels": outside})) == "a sheet lies outside the worksheets"


def test_the_source_on_files(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_bytes(csv_bytes([HEADERS, [str(i), "a"]]))
    (tmp_path / "_log").write_bytes(b"not read")
    bad = csv_bytes([HEADERS, ["1", "a"], ["2", "b", "c"]])
    (tmp_path / "bad.csv").write_bytes(bad)
    found = uploads.read(spark, str(tmp_path), "csv", headers=HEADERS)
    assert found.rdd.getNumPartitions() == 1  # small files share a task
    got = found.collect()
    assert sorted(r["values"]["ID"] for r in got if not r.error) == sorted(map(str, range(30)))
    wrong = [r for r in got if r.error]
    assert [(r.path, r.sha256, r.row_number) for r in wrong] == [(f"{tmp_path}/bad.csv", hashlib.sha256(bad).hexdigest(), None)]
    assert uploads.read(spark, f"{tmp_path}/1*.csv", "csv").count() == 11
    assert uploads.read(spark, f"file://{tmp_path}/bad.csv", "csv").count() == 1
    assert uploads.read(spark, f"{tmp_path}/none*", "csv").count() == 0


def test_a_file_without_a_mapped_row_is_a_problem(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(csv_bytes([["Note", "ID", "Mail"], ["", "1", ""], ["", "", "a"]]))
    (tmp_path / "b.csv").write_bytes(csv_bytes([["Note", "ID", "Mail"], ["", " 1 ", " A@x "], ["", "2", ""]]))
    good, rejects, problems = uploads.registered(spark, str(tmp_path), "luma-csv-v2", "applications", mapping.load_mapping(json.dumps(RAW)))
    assert [(r.path[-5:], r.row_number, r.external_record_id, r.mail, r.applicant_identity, r.authority) for r in good.collect()] == [("b.csv", 2, "1", "A@x", "a@x", None)]
    assert sorted((r.path[-5:], r.row_number, r.reject_code) for r in rejects.collect()) == [("a.csv", 2, "missing_applicant_identity"), ("a.csv", 3, "missing_source_identity"), ("b.csv", 3, "missing_applicant_identity")]
    assert [(r.path[-5:], r.error) for r in problems.collect()] == [("a.csv", "no valid mapped rows")]


def test_mapping_files():
    text = json.dumps(RAW)
    canonical = json.dumps(RAW, sort_keys=True, separators=(",", ":")).encode()
    assert mapping.load_mapping(text, hashlib.sha256(canonical).hexdigest()).wanted() == ["ID", "Mail", "Note"]
    for broken, what in [
        ({"expected_headers": []}, "expected_headers"), ({"expected_headers": ["ID", "ID"]}, "expected_headers"), ({"field_map": {"mail": "X"}}, "unknown headers: X"),
        ({"metadata": []}, "metadata"), ({"source_identity": {}}, "source_identity"), ({"external_id_field": "no"}, "unknown headers: no"),
        ({"metadata": {"requires_explicit_authority": True}}, "authoritative"), ({"metadata": {"requires_explicit_authority": True, "authoritative_fields": ["mail", "x"]}}, "authoritative"),
    ]:
        with pytest.raises(mapping.BadMapping, match=what):
            mapping.load_mapping(json.dumps(RAW | broken))
    with pytest.raises(mapping.BadMapping, match="changed"):
        mapping.load_mapping(text, "0" * 64)
    with pytest.raises(mapping.BadMapping, match="twice"):
        mapping.load_mapping('{"a": 1, "a": 2}')
    with pytest.raises(mapping.BadMapping, match="missing: applicant_identity"):
        mapping.load_mapping("{}")


def test_adapters_and_authority():
    guests = mapping.load_mapping(json.dumps(RAW))
    assert uploads.adapter_of("luma-csv-v2", "applications", guests, None) == ("csv", "single_table", None)
    supplement = RAW | {"source_type": "luma_supplement", "metadata": {"requires_explicit_authority": True, "authoritative_fields": ["mail"], "allowed_authorities": ["luma_final_status_supplement"]}}
    given = mapping.load_mapping(json.dumps(supplement))
    assert uploads.adapter_of("luma-supplement-csv-v1", "attendance", given, None)[2] == "luma_final_status_supplement"
    for args in [("x", "applications", guests, None), ("luma-csv-v2", "attendance", guests, None), ("luma-csv-v2", "applications", given, None), ("luma-csv-v2", "applications", guests, ["A"]), ("mapped-xlsx-v1", "applications", guests, None)]:
        with pytest.raises(mapping.BadMapping):
            uploads.adapter_of(*args)
    supplement["metadata"]["allowed_authorities"] = ["other"]
    with pytest.raises(mapping.BadMapping, match="not allowed"):
        uploads.adapter_of("luma-supplement-csv-v1", "attendance", mapping.load_mapping(json.dumps(supplement)), None)
