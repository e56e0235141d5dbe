"""Suppression by hand-worked cells, identity, sources, streams, and text functions."""

import hashlib
import hmac
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import python_text, text
from cohortlens.operators import matching, predicates, scoring, suppress
from cohortlens.plans import queries
from cohortlens.sources import mapping, tables
from cohortlens.streaming import interactions

# Published counts for k = 5 and N = 100, worked by hand for each rule.
CASES = [
    ([0, 40, 60], {"p1": [60], "p3": [0, 40, 60], "p6": [0, 40, 60], "p7": [0, 40, 60], "p8": [40, 60], "p9": [0, 40, 60]}),
    ([3, 40, 57], {"p1": [57], "p3": [40, 57], "p6": [57], "p7": [], "p8": [], "p9": [40, 57]}),
    ([2, 3, 95], {"p1": [95], "p3": [95], "p6": [95], "p7": [], "p8": [], "p9": [95]}),
    ([0, 3, 97], {"p1": [97], "p3": [0, 97], "p6": [0], "p7": [], "p8": [], "p9": [0]}),
]


@pytest.mark.parametrize(("counts", "expected"), CASES)
def test_worked_suppression(spark, counts, expected):
    cells = spark.createDataFrame([("d", str(i), n, 100) for i, n in enumerate(counts)], "dim string, cell string, n long, total long")
    found = {
        "p1": suppress.p1_distribution(cells, ["dim"], 5), "p3": suppress.p3_point(cells, 5), "p6": suppress.p6_exclusive(cells, ["dim"], 5), "p7": suppress.p7_protected(cells, ["dim"], 5),
        "p8": suppress.p8_reviewed(cells, ["dim"], 5), "p9": suppress.p9_complement(cells, "total", 5),
    }
    assert {k: sorted(r.value for r in df.collect() if r.value is not None) for k, df in found.items()} == expected


def test_cross_cohort_masks_both_sides(spark):
    cells = spark.createDataFrame([("all", "x", 20), ("accepted", "x", 17), ("attended", "x", 5), ("all", "y", 9), ("accepted", "y", 9)], "cohort string, cell string, n long")
    got = {(r.cohort, r.cell): r.value for r in suppress.p14_cross_cohort(cells, predicates.COHORTS, [], 5).collect()}
    assert got == {("all", "x"): None, ("accepted", "x"): None, ("attended", "x"): 5, ("all", "y"): 9, ("accepted", "y"): 9}


def test_selection_reports_ties_and_empty_steps(spark):
    scored = spark.createDataFrame([("a", 5, 9), ("b", 5, 9), ("c", 1, 1)], "model string, x int, y int")
    one = lambda steps: tuple(scoring.selected(scored, steps, [-F.col("x")], "model").first())
    assert one([("y", F.col("y") > 5)]) == (None, "tie")
    assert one([("y", F.col("y") > 50)]) == (None, "y")
    assert one([("y", F.col("y") < 5)]) == ("c", "selected")


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.hmac_sha256(F.lit("msg"), b"k" * 70)) == hmac.new(b"k" * 70, b"msg", hashlib.sha256).hexdigest()
    assert one(text.github(F.lit("https://GitHub.com/Some-One/x"))) == "some-one" and one(text.github(F.lit("https://evil.com/x"))) is None
    assert one(text.linkedin(F.lit("https://uk.linkedin.com/in/Ann-B/?a"))) == "ann-b"
    assert one(text.count_line(F.lit(1), F.lit(40))) == "1 of 40 (2%)" and one(text.exact_percentage(F.lit(1), F.lit(8))) == "12.5"
    assert one(text.token_cost(F.lit(3), F.lit(400_000))) == 2
    assert one(python_text.casefold_nfkc(F.lit(" Straßeﬁ "))) == "strassefi"
    assert python_text.visible("<p>a<script>x</p>y</script> b<svg>c</svg></p>") == "a b"
    assert python_text.visible("<p>one</p><svg/><p>two</p>") == "one two" and python_text.visible("<p>one<svg></svg ><p>two") == "one two"
    assert python_text.visible('<a title="x>y">link</a> <b a=\'>\' c="<i>">bold</b> <i x=">open</i> end') == "link bold open end"
    assert python_text.visible("<a " * 3000) == ("<a " * 3000).strip()[:4000]


def sheet(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_csv_and_xlsx_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,mail\n1,"x\ny"\n2\n'.encode())
    (tmp_path / "b.csv").write_bytes(b"id\n1,2\n")
    got = {(r.path.rpartition("/")[2], r.row_number): (r["values"], r.error) for r in tables.scanned(spark, f"{tmp_path}/*.csv", "csv").collect()}
    assert got["a.csv", 2][0] == ["1", "x\ny"] and got["a.csv", 3][0] == ["2", ""] and "row 2" in got["b.csv", None][1]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2"/></row><row r="4"><c r="B4"><v>7</v></c></row>'
    assert list(tables.xlsx_rows(sheet(rows))) == [("S", 1, ["shared", "", "in"]), ("S", 4, ["", "7", ""])]
    with pytest.raises(tables.Rejected):
        list(tables.xlsx_rows(b"no zip"))


def test_mapping_rejects_rows_and_drift(spark):
    m = mapping.Mapping("v1", {"external_id": "ID", "email": "Mail"}, ["external_id"], ["email"])
    with pytest.raises(mapping.HeaderDrift, match="unexpected: X; missing: Mail"):
        m.check(["ID", "X"])
    rows = spark.createDataFrame([(2, "", {"ID": " 1 ", "Mail": "a"}), (3, "", {"ID": "", "Mail": "a"}), (4, "", {"ID": "2", "Mail": " "})], "row_number int, source_partition string, values map<string,string>")
    good, bad = mapping.mapped(rows, m)
    assert [(r.external_id, r.email) for r in good.collect()] == [("1", "a")]
    assert {r.row_number: r.reject_code for r in bad.collect()} == {3: "missing_source_identity", 4: "missing_applicant_identity"}


def test_stream_of_files_is_ingested_once(spark, tmp_path):
    row = lambda d, a: spark.createDataFrame([(d, "csv", "e", a)], "digest string, source_type string, event string, arrival long")
    row("x", 1).unionByName(row("x", 2)).unionByName(row("y", 3)).write.parquet(f"{tmp_path}/in/1")
    for _ in range(2):
        stream = spark.readStream.schema(row("x", 1).schema).parquet(f"{tmp_path}/in/*")
        interactions.ingest(stream, f"{tmp_path}/manifest", f"{tmp_path}/sink", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        row("y", 9).unionByName(row("z", 4)).write.mode("overwrite").parquet(f"{tmp_path}/in/2")
    got = spark.read.parquet(f"{tmp_path}/sink/*").collect()
    assert sorted((r.digest, r.arrival) for r in got) == [("x", 1), ("y", 3), ("z", 4)]
    assert sorted((r.digest, r.batch) for r in spark.read.parquet(f"{tmp_path}/manifest").collect()) == [("x", 0), ("y", 0), ("z", 1)]


def test_allowed_properties(spark):
    rows = [("metric_selected", {"cohort_key": "all", "metric_key": "BAD KEY", "x": "y"}), ("report_opened", {"a": "b"}), ("other", {})]
    got = interactions.allowed(spark.createDataFrame(rows, "event string, props map<string,string>")).collect()
    assert [(r.event, r.props) for r in got] == [("metric_selected", {"cohort_key": "all"}), ("report_opened", {})]


def test_pages_reach_python_a_hundred_at_a_time(spark):
    """Thousands of pages at once, as in an Arrow batch, take memory by their length."""
    df = spark.range(1).select(python_text.visible_text(F.lit("<p>a</p>")).alias("t"))
    assert "BatchEvalPython" in df._jdf.queryExecution().executedPlan().toString() and df.first().t == "a"


def test_visible_text_is_whole(spark, tmp_path):
    """What stands behind the first 4,000 characters is text too."""
    body = "".join(f"<p>word{i} &amp; <b>more</b></p><script>'</p>'</script>" for i in range(2000))
    spark.createDataFrame([(1, body), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in queries.visible_text(spark, str(tmp_path)).collect()}
    assert got == {1: " ".join(f"word{i} & more" for i in range(2000)), 2: None, 3: ""}
