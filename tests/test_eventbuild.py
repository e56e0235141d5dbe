"""An event from its sources, by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import eventbuild
from cohortlens.operators.eventbuild import Source

BASE = "row_number int, source_partition string, external_record_id string, applicant_identity string"


def frame(spark, fields, rows):
    extra = "".join(f", {f} string" for f in fields)
    return spark.createDataFrame([(i, "S", *r) for i, r in enumerate(rows, 2)], BASE + extra)


def sources(spark, reverse=False):
    turned = (lambda rows: rows[::-1]) if reverse else (lambda rows: rows)
    return {
        "applications": Source(frame(spark, ["github", "team_id"], turned([("1", "a", " g ", "T9"), ("2", "a", None, ""), ("3", "b", " ", None), ("4", None, "g", "")])), required=True),
        "attendance": Source(frame(spark, ["approval_status", "checked_in_at"], turned([("1", "a", " Approved", "12"), ("1", "a", " Approved", "12"), ("2", "b", "new state", None), ("3", "z", "approved", "")])), positive=("approved",)),
        "teams": Source(frame(spark, ["team_id", "track"], turned([("1", "a", "T1", "x"), ("2", "b", "T1", " x "), ("3", "a", "T2", "x"), ("4", "b", "T2", None), ("5", "b", " ", "x")]))),
        "submissions": Source(
            frame(spark, ["project_id", "team_id", "submission_status", "track", "demo"], turned([
                ("1", "a", "P1", "T1", "Done", "x", "d"), ("2", "b", "P1", "T1", "done", "x", "e"), ("3", "a", "P2", "", "draft", None, ""), ("4", "b", "P3", "T3", "done", "y", ""), ("5", "a", "P3", "T3", "draft", "y", ""),
                ("6", "a", "P4", "T2", "done", "x", ""), ("7", "a", None, "T1", "done", "x", ""),
            ])), positive=("done",),
        ),
    }


def test_relations(spark):
    got = eventbuild.build(spark, "e", sources(spark))
    assert sorted((r.role, r.row_number, r.problem) for r in got["outcomes"].collect() if r.problem) == [
        ("attendance", 5, "invalid_relation"), ("submissions", 5, "project"), ("submissions", 6, "project"), ("submissions", 7, "team"), ("submissions", 8, "malformed_record"),
        ("teams", 4, "team"), ("teams", 5, "team"), ("teams", 6, "malformed_record"),
    ]
    people = {r.applicant_ref: (r.github_supplied, r.n_sources) for r in got["applicants"].collect()}
    # a: two applications, one attendance (twice), one team, two projects and the malformed submission; b: also its malformed team.
    assert sorted(people.values()) == [(False, 5), (True, 1), (True, 7)]
    assert sorted((r.accepted, r.present) for r in got["attendance"].collect() if r.accepted) == [(True, True), (True, True)]
    assert [(r.accepted, r.present) for r in got["attendance"].collect() if not r.accepted] == [(None, None)]
    assert [r.track for r in got["teams"].collect()] == ["x"]
    assert sorted((r.submitted or False, r.track or "", r.team_ref is None, r.repository_supplied, r.demo_supplied) for r in got["projects"].collect()) == [(False, "", True, None, False), (True, "x", False, None, True)]
    assert got["team_members"].count() == 2 and got["project_members"].count() == 2
    accounts = {r.role: (r.n_in, r.n_kept, r.n_rejected, r.n_conflicts) for r in eventbuild.accounts(got["outcomes"]).collect()}
    assert accounts == {"applications": (4, 4, 0, 0), "attendance": (4, 3, 1, 0), "teams": (5, 2, 1, 2), "submissions": (7, 3, 1, 3)}
    assert eventbuild.integrity(got).count() == 0


def test_order_of_rows_changes_nothing(spark):
    one, other = eventbuild.build(spark, "e", sources(spark)), eventbuild.build(spark, "e", sources(spark, True))
    for name in one:
        if name not in ("outcomes", "coverage"):
            assert sorted(map(str, one[name].collect())) == sorted(map(str, other[name].collect())), name


def test_missing_and_empty_sources(spark):
    given = sources(spark)
    got = eventbuild.build(spark, "e", {**given, "submissions": Source(None)})
    assert [tuple(r) for r in got["coverage"].collect()] == [("applications", True, "available"), ("attendance", False, "available"), ("submissions", False, "missing_optional"), ("teams", False, "available")]
    assert got["teams"].count() == 1 and got["projects"].count() == 0 and got["project_members"].count() == 0
    nothing = eventbuild.build(spark, "e", {r: Source(s.rows.where("false")) for r, s in given.items()})
    assert all(nothing[n].count() == 0 for n in nothing if n != "coverage")
    with pytest.raises(ValueError, match="required sources are missing: teams"):
        eventbuild.build(spark, "e", {**given, "teams": Source(None, required=True)})
    with pytest.raises(ValueError, match="applications are needed"):
        eventbuild.build(spark, "e", {"teams": given["teams"]})
    with pytest.raises(ValueError, match="teams lacks track"):
        eventbuild.build(spark, "e", {**given, "teams": Source(given["teams"].rows.drop("track"))})


def test_doubled_record_ids_and_rejects(spark):
    rows = frame(spark, [], [("1", "a"), ("1", "b"), ("2", "c")]).withColumn("conflict", F.lit("own")).withColumn("known", F.lit(1))
    got = eventbuild.build(spark, "e", {"applications": Source(rows, spark.createDataFrame([(9, "S")], "row_number int, source_partition string"), unique_ids=True)})
    assert sorted((r.row_number, r.outcome, r.problem) for r in got["outcomes"].collect()) == [(2, "conflict", "doubled_record"), (3, "conflict", "doubled_record"), (4, "kept", None), (9, "rejected", "missing_stable_id")]
    assert got["applicants"].count() == 1


def test_ids_are_stored_as_given(spark, monkeypatch):
    """References are many times as long as ids: stored with every row they took most of the disk."""
    written, before = [], eventbuild.stored
    monkeypatch.setattr(eventbuild, "stored", lambda df, *a, **k: written.append(df.columns) or before(df, *a, **k))
    eventbuild.build(spark, "e", sources(spark))
    assert written and not [c for columns in written for c in columns if c.endswith("_ref")]


def test_rows_meet_their_own_identities_and_leave_no_shuffle(spark, monkeypatch):
    """All rows were shuffled to meet the whole population, and the files of each role's shuffle stayed."""
    written, before = [], eventbuild.stored
    monkeypatch.setattr(eventbuild, "stored", lambda df, name, *a, **k: written.append((name, before(df, name, *a, **k), k.get("tidy"))) or written[-1][1])
    eventbuild.build(spark, "e", {**sources(spark), "attendance": Source(frame(spark, ["approval_status", "checked_in_at"], [("1", "b", "x", ""), ("2", "z", "x", ""), ("3", "b", "x", "")]))})
    assert written and all(tidy for *_, tidy in written)
    assert sorted(sorted(r.identity for r in df.collect()) for name, df, _ in written if name == "event-known") == [["a", "b"], ["a", "b"], ["b"]]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_an_id_like_a_row_of_its_own(spark):
    teams = frame(spark, ["team_id", "track"], [("1", "a", "row:4:S", "x"), ("2", "a", "row:4:S", "y")])
    submissions = frame(spark, ["project_id", "team_id", "submission_status", "track"], [("1", "a", "P1", "T1", "done", "x"), ("2", "a", "P2", "T1", "done", "x"), ("3", "a", "P3", None, "done", "x")])
    got = eventbuild.build(spark, "e", {"applications": Source(frame(spark, [], [("1", "a")])), "teams": Source(teams), "submissions": Source(submissions, positive=("done",))})
    assert sorted((r.role, r.row_number, r.problem) for r in got["outcomes"].collect() if r.problem) == [("teams", 2, "team"), ("teams", 3, "team")]


def test_broken_references(spark):
    got = eventbuild.build(spark, "e", sources(spark))
    lone = got["teams"].where("false")
    assert {r.rule for r in eventbuild.integrity({**got, "teams": lone}).collect()} == {"team_members: unknown team_ref", "projects: unknown team_ref"}
    assert {r.rule for r in eventbuild.integrity({**got, "projects": got["projects"].withColumn("submitted", F.lit(None).cast("boolean"))}).collect()} == {"project_members: unknown project_ref"}
    assert {r.rule for r in eventbuild.integrity({**got, "applicants": got["applicants"].unionByName(got["applicants"])}).collect()} == {"applicants: doubled"}


def test_a_broken_reference_of_many_rows(spark, monkeypatch):
    """Each row is found, though a key's rows meet no join: what is joined is one row a key."""
    monkeypatch.setattr(eventbuild, "PART_ROWS", 7)
    got = eventbuild.build(spark, "e", sources(spark))
    many = spark.range(100).select(F.when(F.col("id") < 93, "lost").alias("applicant_ref"), F.lit("s").alias("source_ref"), F.lit(True).alias("accepted"), F.lit(True).alias("present"))
    found = eventbuild.integrity({**got, "attendance": many})
    assert sorted((r.rule, r.ref, r["count"]) for r in found.groupBy("rule", "ref").count().collect() if r.ref) == [("attendance: unknown applicant_ref", "lost", 93)]
    assert found.where("ref is null").count() == 7
    left = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in line]
    assert left and "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString().split(left[0])[1].splitlines()[1]
