"""The identity ladder in rounds against a plain fold over the records in order."""

import random

import pytest

from cohortlens.operators import identity, staging
from pyspark.sql import functions as F

SCHEMA = "record long, place int, email string, github string, linkedin string, provided array<string>, name string, team string, affiliation string"


def fold(rows, aliases=()):
    aliases, people, out = dict(aliases), {}, {}
    blank = lambda v: (v or "").strip()

    def person(n):
        return people.setdefault(n, {"began": len(people), "records": []})

    for n in sorted(set(aliases.values())):
        person(n)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        record, _, email, github, linkedin, provided, name, team, affiliation = r
        profiles = {"github": blank(github), "linkedin": blank(linkedin)}
        strong, matched, one_sided, weak = set(), set(), set(), set()
        for n, p in people.items():
            for e in p["records"]:
                if blank(email) and blank(email) == blank(e[2]):
                    strong.add(n)
                for i, (kind, value) in enumerate(profiles.items()):
                    if value and value == blank(e[3 + i]):
                        if kind in provided and kind in e[5]:
                            strong.add(n)
                            matched.add(n)
                        else:
                            one_sided.add(n)
                same = blank(name).lower() and blank(name).lower() == blank(e[6]).lower()
                if same and any(blank(a).lower() and blank(a).lower() == blank(b).lower() for a, b in ((team, e[7]), (affiliation, e[8]))):
                    weak.add(n)
        if record in aliases:
            strong.add(aliases[record])
        if len(strong) > 1:
            out[record] = None, "quarantined", "STRONG_IDENTIFIER_CONFLICT", None
            continue
        if strong:
            n = strong.pop()
            mails = {blank(e[2]) for e in people[n]["records"]} - {""}
            if aliases.get(record) == n:
                reason = "EXPLICIT_SOURCE_RECORD_ALIAS"
            elif n in matched:
                reason = "BILATERAL_APPLICANT_PROFILE" + ("_EMAIL_MISMATCH" if blank(email) and mails and blank(email) not in mails else "")
            else:
                reason = "EXACT_EMAIL"
            out[record] = n, "merged", reason, None
        else:
            n, hints = record, one_sided | weak
            reason = "PROFILE_EVIDENCE_NOT_BILATERAL" if one_sided else "WEAK_NAME_CONTEXT_MATCH" if weak else "NO_STRONG_MATCH"
            out[record] = n, "review" if hints else "new", reason, min(hints, key=lambda h: people[h]["began"]) if hints else None
        person(n)["records"].append(r)
    return out


def given(spark, rows, aliases=()):
    named = spark.createDataFrame(list(aliases), "record long, person long") if aliases else None
    return {r["record"]: (r["person"], r["outcome"], r["reason"], r["suggested"]) for r in identity.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), named).collect()}


def some(rng, n, values):
    pick = lambda chance, prefix: f"{prefix}{rng.randrange(values)}" if rng.random() < chance else rng.choice([None, "", " "])
    return [(i * 3 % 101 + i * 1000, rng.randrange(3), pick(0.6, "m"), pick(0.4, "g"), pick(0.3, "l"), rng.choice([[], ["github"], ["github", "linkedin"]]), pick(0.5, "N"), pick(0.5, "t"), pick(0.3, "a")) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "values"), [(1, 60, 8), (2, 60, 20), (3, 120, 60)])
def test_random_records(spark, seed, n, values):
    rows = some(random.Random(seed), n, values)
    expected = fold(rows)
    assert given(spark, rows) == expected
    assert {o[1] for o in expected.values()} >= {"merged", "new", "quarantined"}


def test_aliases(spark):
    rows = some(random.Random(4), 50, 15)
    aliases = [(rows[7][0], rows[0][0]), (rows[20][0], rows[1][0]), (rows[30][0], -5)]
    began = sorted(rows, key=lambda r: (r[1], r[0]))[:2]
    aliases = [(a, b) if b == -5 else (a, began[i][0]) for i, (a, b) in enumerate(aliases)]
    # The fold numbers aliased persons first, so they are taken from records that begin persons anyway.
    found, expected = given(spark, rows, aliases[2:]), fold(rows, aliases[2:])
    assert found == expected


def test_by_hand(spark):
    given_ = ["github"]
    rows = [
        (1, 0, "a@x", None, None, given_, "Ann", "t", None), (2, 0, "b@x", "h", None, given_, "Bob", "t", None), (3, 1, "a@x", None, None, given_, None, None, None),
        (4, 1, "a@x", "h", None, given_, None, None, None), (5, 1, None, None, None, given_, "Ann", "t", None), (6, 1, None, None, None, given_, None, None, None), (7, 1, "c@x", "h", None, given_, None, None, None), (8, 1, None, "h", None, [], None, None, None),
    ]
    assert {k: v[:3] for k, v in given(spark, rows).items()} == {
        1: (1, "new", "NO_STRONG_MATCH"), 2: (2, "new", "NO_STRONG_MATCH"), 3: (1, "merged", "EXACT_EMAIL"), 4: (None, "quarantined", "STRONG_IDENTIFIER_CONFLICT"),
        5: (5, "review", "WEAK_NAME_CONTEXT_MATCH"), 6: (6, "new", "NO_STRONG_MATCH"), 7: (2, "merged", "BILATERAL_APPLICANT_PROFILE_EMAIL_MISMATCH"), 8: (8, "review", "PROFILE_EVIDENCE_NOT_BILATERAL"),
    }


def test_a_hot_identifier_takes_no_round_of_its_own(spark, monkeypatch):
    rows = [(i, 0, "junk" if i % 3 == 0 else f"m{i // 2}", f"g{i % 40}", None, ["github"], None, None, None) for i in range(1, 300)]
    rounds = []
    monkeypatch.setattr(identity, "stored", lambda df, name, path=None: (rounds.append(name), staging.stored(df, name, path))[1])
    assert given(spark, rows) == fold(rows)
    assert rounds.count("settled") < 12


def test_a_chain_is_followed_to_its_end(spark):
    rows = [(i, 0, f"m{i}" if i % 2 else f"m{i - 1}", f"g{i // 2}", None, ["github"], None, None, None) for i in range(1, 14)]
    assert given(spark, rows) == fold(rows)


def test_no_rows_and_doubles(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert identity.resolve(none).count() == 0
    assert [tuple(r) for r in identity.duplicates(spark.range(3).selectExpr("id % 2 AS record")).collect()] == [(0, 2)]


@pytest.mark.parametrize("how", ["sum", "min"])
def test_running(spark, how):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.choice([None, 1, 2, 7])) for i in rng.sample(range(300), 200)]
    got = {(r["g"], r["i"]): r["x"] for r in staging.running(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["g"], ["i"], F.col("v"), "x", how).collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j < i and v is not None]
        assert got[g, i] == (sum(before) if how == "sum" else min(before, default=None))
