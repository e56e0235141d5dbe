"""Versions of a keyed table, facts laid over classifications, and decisions on reviews."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import overlays, reviews
from cohortlens.sources.versioned import Stale, VersionedTable


@pytest.fixture
def store(spark, tmp_path):
    found = VersionedTable(spark, f"file://{tmp_path}/table", ["k"], 8)
    found.create(rows(spark, [(i, f"v{i}") for i in range(40)] + [(None, "none")]))
    return found


def rows(spark, values):
    return spark.createDataFrame(values, "k int, v string")


def content(store, version=None):
    return {r["k"]: r["v"] for r in store.read(version).collect()}


def test_an_upsert_rewrites_its_buckets_alone(spark, store):
    before = store.folders()
    assert store.upsert(rows(spark, [(3, "new"), (100, "more"), (5, "v5"), (None, "other")]), 1) == 2
    assert content(store) == {i: f"v{i}" for i in range(40)} | {3: "new", 100: "more", None: "other"}
    assert content(store, 1)[3] == "v3"
    moved = {b for b in store.folders() if store.folders()[b] != before.get(b)}
    keys = spark.createDataFrame([(3,), (100,), (None,)], "k int").select(store._bucket().alias("b"))
    assert moved == {r["b"] for r in keys.collect()}


def test_a_replay_makes_no_version(spark, store):
    batch = rows(spark, [(3, "new"), (100, "more")])
    assert [store.upsert(batch), store.upsert(batch), store.upsert(batch.limit(0))] == [2, 2, 2]


def test_stale_writers_fail(spark, store):
    store.upsert(rows(spark, [(3, "a")]), 1)
    with pytest.raises(Stale):
        store.upsert(rows(spark, [(4, "b")]), 1)
    with pytest.raises(Stale):
        store.create(rows(spark, []))
    with pytest.raises(ValueError):
        store.upsert(rows(spark, [(4, "b"), (4, "c")]))
    assert content(store) == {i: f"v{i}" for i in range(40)} | {3: "a", None: "none"}


def test_of_racing_writers_one_wins(spark, store, monkeypatch):
    barrier, results = threading.Barrier(2), []
    commit = VersionedTable._commit
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, *a: (barrier.wait(60), commit(self, *a))[1])

    def write(value):
        try:
            results.append(store.upsert(rows(spark, [(1, value)]), 1))
        except Stale:
            results.append("stale")

    threads = [threading.Thread(target=write, args=(v,)) for v in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    # A local file system checks and then creates, so both may take the version; readers see one of them whole.
    assert 2 in results and content(store)[1] in ("a", "b")


def test_a_dead_writer_is_cleared_away(spark, store, tmp_path):
    (tmp_path / "table/versions/2").touch()
    assert store.version() == 1
    with pytest.raises(Stale):
        store.upsert(rows(spark, [(1, "a")]))
    store.recover()
    assert store.upsert(rows(spark, [(1, "a")])) == 2


def classified(spark, seniority, reasons=(), fingerprint=None, subject="s"):
    dims = {n: (["unknown"], 0.9, [], "unknown") for n in ("professional_identity", "functional_role", "builder_evidence")} | {"seniority": (seniority, 0.9, ["e"], "observed")}
    return spark.createDataFrame([(subject, dims, list(reasons), "resolved", fingerprint)], f"subject_ref string, dimensions map<string,{overlays.DIMENSION}>, review_reasons array<string>, review_state string, fingerprint string")


def facts(spark, company="public", seniority="other", title="other", founder=False, state="observed", subject="s", ref="evidence:career:" + "0" * 64):
    return spark.createDataFrame([(subject, company, seniority, title, founder, ref, state)], "subject_ref string, company_category string, seniority string, title_category string, founder_history boolean, evidence_ref string, state string")


def test_overlays(spark):
    over = lambda base, f, c=None: [r.asDict(True) for r in overlays.laid_over(base, f, c).collect()]
    one = over(classified(spark, ["unknown", "senior"]), facts(spark, "Startup", "Senior"))[0]
    assert one["dimensions"]["professional_identity"]["labels"] == ["startup_operator"] and one["dimensions"]["professional_identity"]["confidence"] == 0.9
    assert one["dimensions"]["seniority"]["labels"] == ["senior"] and one["dimensions"]["seniority"]["confidence"] == 0.8 and one["review_state"] == "resolved"
    assert one["dimensions"]["seniority"]["evidence_refs"] == ["e", "evidence:career:" + "0" * 64]
    two = over(classified(spark, ["junior"], ["earlier"]), facts(spark, seniority="head", founder=True))[0]
    assert two["review_reasons"] == ["conflicting_evidence", "consequential_claim", "earlier"] and two["review_state"] == "pending" and two["dimensions"]["seniority"]["labels"] == ["founder"]
    nothing = over(classified(spark, ["junior"]), facts(spark))[0]
    assert nothing["dimensions"]["functional_role"]["labels"] == ["unknown"] and nothing["fingerprint"]
    assert over(classified(spark, ["junior"], fingerprint=nothing["fingerprint"]), facts(spark)) == []
    corrected = over(classified(spark, ["junior"]), facts(spark, title="software_engineering"), classified(spark, ["senior"]).select("subject_ref", "dimensions"))[0]
    assert corrected["dimensions"]["seniority"]["labels"] == ["senior"] and corrected["review_reasons"] == ["prior_human_correction"]


def test_facts_that_may_not_be_laid_over(spark):
    base = classified(spark, ["junior"]).unionByName(classified(spark, ["junior"], subject="t"))
    given = facts(spark).unionByName(facts(spark)).unionByName(facts(spark, subject="x")).unionByName(facts(spark, subject="t", ref="no evidence"))
    assert {tuple(r) for r in overlays.problems(base, given).collect()} == {("s", "repeated"), ("x", "outside_population"), ("t", "invalid")}
    assert overlays.problems(base, facts(spark)).count() == 0


LOG = "decision_id long, source_record_id long, person_id long, decision string, reviewer string, reason string, decided_at string, supersedes long"
NEW = "place long, source_record_id long, person_id long, decision string, reviewer string, reason string, decided_at string, supersedes long"


def test_decisions(spark):
    log = spark.createDataFrame([(1, 10, 5, "linked", "a", "r", "d", None), (2, 10, None, "quarantined", "a", "r", "d", 1), (3, 11, 6, "linked", "a", "r", "d", None)], LOG)
    good = spark.createDataFrame([(1, 10, 7, "linked", "b", "r", "d2", 2), (2, 11, 6, "linked", "a", "r", "d", None), (3, 12, None, "quarantined", "b", "r", "d2", None)], NEW)
    checked = reviews.checked_decisions(log, good)
    assert {(r["place"], r["decision_id"], r["status"]) for r in checked.collect()} == {(1, 4, "applied"), (2, 3, "replayed"), (3, 5, "applied")}
    after = log.unionByName(reviews.appended(log, checked))
    assert {(r["place"], r["decision_id"], r["status"]) for r in reviews.checked_decisions(after, good).collect()} == {(1, 4, "replayed"), (2, 3, "replayed"), (3, 5, "replayed")}
    open_ = spark.createDataFrame([(1, 10, "open", None), (2, 13, "open", None), (3, 11, "resolved", "d0")], "review_id long, source_record_id long, status string, resolved_at string")
    assert {tuple(r) for r in reviews.resolved_reviews(open_, checked).collect()} == {(1, 10, "resolved", "d2"), (2, 13, "open", None), (3, 11, "resolved", "d0")}


def test_wrong_decisions(spark):
    log = spark.createDataFrame([(1, 10, 5, "linked", "a", "r", "d", None), (2, 10, None, "quarantined", "a", "r", "d", 1)], LOG)
    wrong = [
        (1, 10, 5, "linked", "a", "r", "d", None, "not_current"), (2, 20, 1, "perhaps", "a", "r", "d", None, "invalid_decision"), (3, 21, None, "linked", "a", "r", "d", None, "missing_person"), (4, 22, 1, "quarantined", "a", "r", "d", None, "person_given"),
        (5, 23, 1, "linked", " ", "r", "d", None, "missing_reviewer"), (6, 24, 1, "linked", "a", "r", "d", 2, "nothing_to_supersede"), (7, 25, 1, "linked", "a", "r", "d", None, "repeated"), (8, 25, 2, "linked", "a", "r", "d", None, "repeated"), (9, 26, 2, None, "a", "r", "d", None, "invalid_decision"),
    ]
    checked = reviews.checked_decisions(log, spark.createDataFrame([w[:-1] for w in wrong], NEW))
    assert {(r["place"], r["status"]) for r in checked.collect()} == {(w[0], w[-1]) for w in wrong}
    with pytest.raises(ValueError):
        reviews.appended(log, checked)
    none = reviews.checked_decisions(log.limit(0), spark.createDataFrame([], NEW))
    assert none.count() == 0 and reviews.appended(log, none).count() == 0


def test_open_candidates(spark):
    r = spark.createDataFrame([(1, 1, 5, None, "x", "open"), (2, 2, 6, 5, "y", "resolved"), (3, 3, 7, 5, "z", "open")], "review_id int, source_record_id int, provisional_person_id int, suggested_person_id int, reason_code string, status string")
    records, files = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "source_record_id int, source_file_id int"), spark.createDataFrame([(1, 9), (2, 8)], "source_file_id int, event_id int")
    assert [tuple(x) for x in reviews.open_candidates(r, records, files, 9).collect()] == [(1, 1, 5, None, "x")]
