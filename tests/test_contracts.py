"""Contracts, records and rankings by hand-worked cases: nulls, ties and repeats."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import contracts, evidence, populations, records

ITEM = "dim string, item string, value long, known long, whole long, mode string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(
    ("items", "problem"),
    [
        ([("a", 6, 10, 12), ("b", 4, 10, 12)], None), ([("a", 6, None, 12), ("b", 4, None, 12)], "known"), ([("a", 6, 10, 9), ("b", 4, 10, 9)], "known"), ([("a", 11, 10, 12), ("b", None, 10, 12)], "item"),
        ([("a", 6, 10, 12), ("b", 5, 10, 12)], "sum"), ([("a", 6, 10, 12), ("b", None, 10, 12)], "single_withheld"), ([("a", 5, 10, 12), ("b", None, 10, 12), ("c", None, 10, 12)], None), ([("a", 5, 10, 12), ("a", 5, 10, 12)], "repeated"),
    ],
)
def test_exclusive_dimensions(spark, items, problem):
    df = spark.createDataFrame([("d", *i, "exclusive") for i in items], ITEM)
    assert [r["problem"] for r in contracts.dimension_violations(df, ["dim"], "known", "whole", "mode", "item").collect()] == [problem] * (problem is not None)


def test_overlapping_dimensions(spark):
    of = lambda mode, *values: contracts.dimension_violations(spark.createDataFrame([("d", str(i), v, 10, 12, mode) for i, v in enumerate(values)], ITEM), ["dim"], "known", "whole", "mode", "item").collect()
    assert of("overlapping", 9, 8, None) == [] and [r["problem"] for r in of("overlapping", 11, 8)] == ["item"] and [r["problem"] for r in of("other", 5, 5)] == ["mode"] and [r["problem"] for r in of(None, 5, 5)] == ["mode"]


def test_intersections(spark):
    items = spark.createDataFrame([("a", 10), ("b", 8), ("c", None)], "component string, value long")
    given = [(1, ["a", "a", "b"], 5), (2, ["a"], 5), (3, ["a", "z"], 5), (4, ["a", "c"], 5), (5, ["a", "b"], 9), (6, ["a", "b"], 8), (7, ["a", "c"], None), (8, [], 1), (9, ["b", "b"], 1)]
    found = contracts.intersection_violations(spark.createDataFrame(given, "key int, components array<string>, value long"), items, "key")
    assert rows(found, "key", "problem") == [(1, "repeated"), (2, "components"), (3, "unknown"), (4, "over_withheld"), (5, "count"), (8, "components"), (9, "repeated")]


def test_journeys(spark):
    nodes = spark.createDataFrame([("a", 1, 100), ("b", 2, 60), ("c", 2, None), ("d", 3, 58), ("e", 3, 10), ("f", 1, 20)], "node string, place int, size long")
    links = [("a", "b", 60), ("a", "c", None), ("b", "d", 58), ("b", "z", 1), ("d", "d", 1), ("d", "c", 1), ("f", "e", 11), ("f", "e", 11), ("c", "e", 5)]
    found = contracts.journey_violations(spark.createDataFrame(links, "source string, target string, n long"), nodes, 5)
    assert rows(found, "source", "target", "node", "problem") == sorted([
        ("b", "d", None, "nested_remainder"), ("b", "z", None, "unknown_node"), ("d", "d", None, "self"), ("d", "c", None, "backward"), ("f", "e", None, "endpoint"),
        (None, None, "a", "single_withheld"), (None, None, "d", "incoming"), (None, None, "e", "incoming"), (None, None, "f", "outgoing"),
    ], key=str)
    two = spark.createDataFrame([("a", "b", 97), ("a", "c", None), ("a", "d", None)], "source string, target string, n long")
    assert ("a", "withheld_remainder") in rows(contracts.journey_violations(two, nodes, 5), "node", "problem")
    again = spark.createDataFrame([("f", "e", 3), ("f", "e", 4)], "source string, target string, n long")
    assert rows(contracts.journey_violations(again, nodes, 5), "source", "problem") == [("f", "repeated")]


def test_rich_projects_break_ties_by_the_other_measure(spark):
    p = spark.createDataFrame([("o", 5, 1, 0), ("o", 5, 9, 1), ("o", 5, 8, 2), ("o", 1, 7, 3)], "owner string, engagement int, recency int, place int")
    found = populations.rich_projects(p, "owner", "engagement", "recency", "place").orderBy("rank")
    assert [r["place"] for r in found.collect()] == [1, 2, 0]
    same = spark.createDataFrame([("o", 1, 1, i) for i in range(5)] + [(None, 1, 1, 9)], "owner string, engagement int, recency int, place int")
    assert rows(populations.rich_projects(same, "owner", "engagement", "recency", "place"), "owner", "place", "rank") == [("o", 0, 1), ("o", 1, 2), ("o", 2, 3), (None, 9, 1)]


def test_cache_keys_tell_nulls_apart(spark):
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    r = spark.createDataFrame([("a", None, "x"), ("b", "x", None), ("c", "x", "")], "r string, p string, q string")
    keys = {x["k"] for x in r.select(records.cache_key("names", "v1", ["p", "q"]).alias("k")).collect()}
    assert len(keys) == 3 and all(k.startswith("names:") for k in keys)
    cache = r.where("r = 'a'").select(records.cache_key("names", "v1", ["q", "p"]).alias("cache_key"), F.lit("of a").alias("payload"), F.lit("2026-02-01").cast("timestamp_ntz").alias("expires_at"))
    assert rows(records.cached(r, cache, "names", "v1", ["p", "q"], now), "r", "payload") == [("a", "of a"), ("b", None), ("c", None)]
    assert rows(records.cached(r, cache, "other", "v1", ["p", "q"], now), "payload") == [(None,)] * 3
    with pytest.raises(ValueError):
        records.cache_key("No name", "v1", ["p"])


def test_expired_entries_go_with_a_receipt(spark):
    cache = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2026-01-01'), ('b', TIMESTAMP_NTZ'2026-01-02'), ('c', NULL) AS t(cache_key, expires_at)").withColumn("payload", F.lit("p"))
    kept, gone = records.without_expired(cache, F.lit("2026-01-01").cast("timestamp_ntz"))
    assert rows(kept, "cache_key") == [("b",)] and rows(gone, "cache_key") == [("a",), ("c",)]


def test_doubled_reviews_double_no_record(spark):
    exact = spark.createDataFrame([("r1", 1)], "source_ref string, person int")
    decisions = spark.createDataFrame([("r2", "approve", 2), ("r2", "approve", 2), ("r3", "approve", 3), ("r3", "reject", None), ("r4", "reject", 9), ("r5", None, None)], "source_ref string, action string, person int")
    assert rows(records.resolved_links(exact, decisions), "source_ref", "person", "link") == [("r1", 1, "exact"), ("r2", 2, "approved"), ("r3", None, "conflict"), ("r4", None, "quarantined"), ("r5", None, "unresolved")]
    cases = spark.createDataFrame([("c1", "h"), ("c2", "h"), ("c3", "h"), ("c4", "h")], "case_code string, case_hash string")
    old = spark.createDataFrame([("c1", "h", "ok"), ("c1", "h", "ok"), ("c2", "h", "ok"), ("c2", "h", "no"), ("c3", "g", "ok"), ("c4", "h", "ok"), ("c4", "g", "no")], "case_code string, case_hash string, decision string")
    assert rows(records.refreshed(cases, old), "case_code", "decision") == [("c1", "ok"), ("c2", None), ("c3", None), ("c4", "ok")]
    aliases = spark.createDataFrame([("s", "1", 7), ("s", "2", 7), ("s", "2", 8), ("s", "3", 9), ("s", "3", 9)], "source_type string, external_id string, person_id int")
    found = evidence.aliased(spark.createDataFrame([("s", str(i)) for i in range(1, 5)], "source_type string, external_id string"), aliases)
    assert rows(found, "external_id", "alias_person") == [("1", 7), ("2", None), ("3", 9), ("4", None)]
    assert rows(evidence.alias_conflicts(aliases), "external_id", "n") == [("2", 2), ("3", 2)]


def test_literals_either_way(spark):
    texts = spark.createDataFrame([(1, "Ann Lee met ann-lee, LEE ann"), (2, None), (3, "annlee"), (4, "x Ann"), (5, ""), (5, "the ann lee met")], "k int, t string")
    literals = spark.createDataFrame([("Ann Lee",), ("ann lee",), ("lee ann",), ("met",), ("Ann",), (None,), ("x ann lee",), ("Ann Lee Met",)], "l string")
    few, many = (rows(records.known_literals(texts, "k", "t", literals, "l", n), "k", "form") for n in (100, 0))
    assert few == many == [(1, "ann lee met"), (1, "ann lee"), (1, "lee ann"), (5, "ann lee met"), (5, "ann lee")]
