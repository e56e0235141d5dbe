"""Review planning against a plain loop over the inputs in order."""

import random

import pytest

from cohortlens.operators import reviews

SECRET = b"a secret of the tests"


def greedy(preferences, projects):
    used, links, cases = set(), {}, {}
    name = lambda v: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (v or "").lower()).split())
    for _, team, team_name, track in sorted(preferences):
        exact = [p for p, n, t in projects if name(n) == name(team_name) and (t or "") == (track or "") and p not in used]
        if len(exact) == 1:
            links[team] = exact[0]
            used.add(exact[0])
        else:
            cases[team] = {p for p, _, t in projects if (t or "") == (track or "") and p not in used}
    return links, cases


@pytest.mark.parametrize("seed", range(4))
def test_teams(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice(["A-1", "a 1", "b", "B!", "c", "", None, "d", "e"])
    preferences = [(i * 7 % 83, i, some(), rng.choice(["x", "x", "y", None])) for i in range(60)]
    projects = [(i, some(), rng.choice(["x", "x", "y", "", None])) for i in range(rng.randint(0, 25))]
    p = spark.createDataFrame(preferences, "place int, team_id int, name string, track string").repartition(3)
    q = spark.createDataFrame(projects, "project_id int, name string, track string")
    links, cases = greedy(preferences, projects)
    plan = reviews.team_plan(p, q, SECRET).collect()
    assert {r["team_id"]: r["project_id"] for r in plan if r["project_id"] is not None} == links
    opened = {r["team_id"]: r for r in plan if r["project_id"] is None}
    assert {t: r["n_candidates"] for t, r in opened.items()} == {t: len(c) for t, c in cases.items()}
    found = {t: set() for t in cases}
    for r in reviews.team_candidates(spark.createDataFrame([(t,) for t in cases], "team_id int"), p, q).collect():
        found[r["team_id"]].add(r["project_id"])
    assert found == cases
    # A case's digest follows from the set of its candidates alone.
    digests = {}
    for t, c in cases.items():
        digests.setdefault(frozenset(c), set()).add(opened[t]["candidates_xor"])
    assert all(len(d) == 1 for d in digests.values()) and len(set.union(*digests.values())) == len(digests)
    assert len({r["case_code"] for r in opened.values()}) == len(cases)


def test_people(spark):
    applications = spark.createDataFrame([("1", "A@x ", "Ann  Lee"), ("2", "b@x", "ann-lee"), ("3", "c@x", None), ("4", "d@x", "Bob")], "external_id string, email string, name string")
    members = spark.createDataFrame([("p", "r1", " a@X", "whoever"), ("p", "r2", "z@x", "ANN LEE"), ("s", "r3", None, ""), ("s", "r4", "y@x", "bob")], "source_kind string, source_ref string, email string, name string")
    plan = reviews.people_plan(applications, members, SECRET)
    rows = {r["source_ref"]: r for r in plan.collect()}
    assert {k: (r["external_id"], r["n_candidates"]) for k, r in rows.items()} == {"r1": ("1", None), "r2": (None, 2), "r3": (None, 0), "r4": (None, 1)}
    assert rows["r2"]["case_code"] == "identity_" + rows["r2"]["case_hash"][:16] and rows["r1"]["case_code"] is None
    candidates = reviews.identity_candidates(plan.where("case_code is not null"), members, applications)
    assert {tuple(r) for r in candidates.collect()} == {("p", "r2", "1"), ("p", "r2", "2"), ("s", "r4", "4")}
    less = {r["source_ref"]: r["case_code"] for r in reviews.people_plan(applications.where("external_id <> '2'"), members, SECRET).collect()}
    assert less["r2"] != rows["r2"]["case_code"] and less["r4"] == rows["r4"]["case_code"]
    assert reviews.people_plan(applications.limit(0), members.limit(0), SECRET).count() == 0


def test_problems(spark):
    applications = spark.createDataFrame([("1", "a@x"), ("2", "A@x"), (None, "c@x"), ("4", " ")], "external_id string, email string")
    members = spark.createDataFrame([("r",), ("r",), (None,), ("s",)], "source_ref string")
    assert {tuple(r) for r in reviews.problems(applications, members).collect()} == {
        ("repeated_email", "a@x", 2), ("incomplete_application", None, 1), ("incomplete_application", "4", 1), ("repeated_reference", "r", 2), ("missing_reference", None, 1),
    }
