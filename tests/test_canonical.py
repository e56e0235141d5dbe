"""Canonical JSON against Python's, and digests of tables."""

import json
import random

import pytest

from cohortlens.functions import canonical

HARD = ["", "plain", 'quote " and \\ and /', "\x00\x01\x1f\x7f\x80", "\b\f\n\r\t", "é ß 中  ", "😀 𝒳", "a￾￿", "x" * 5000, None, "eiń"]


def dumps(value):
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"), allow_nan=False)


def test_rows(spark):
    rng = random.Random(1)
    doubles = [0.0, -0.0, 1.0, 0.1, 1e16, 1e22, 1.5e300, 5e-324, 2e23, 123456789.125, 1e-5, 2**-44, None]
    rows = []
    for i, text in enumerate(HARD * 3):
        rows.append((i - 5, text, rng.choice(doubles), rng.choice([True, False, None]), rng.choice([None, [], ["b", None, "é"]]), rng.choice([None, {}, {"z": 1, "é": None, "Z": 3, "😀": 4, "￿": 5}]), (rng.choice(HARD), rng.choice(doubles)), rng.choice([None, 2**62])))
    df = spark.createDataFrame(rows, 'i int, `b"é` string, d double, t boolean, a array<string>, m map<string,int>, s struct<y:string,x:double>, l long')
    for r in df.withColumn("json", canonical.canonical_rows(df)).collect():
        value = r.asDict(True)
        found = value.pop("json")
        assert found == dumps(value)


def test_what_json_lacks(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="no NaN"):
        df.select(canonical.canonical_rows(df)).collect()
    for kind in ("date", "decimal(3,1)", "binary", "array<double>", "map<int,string>"):
        with pytest.raises(TypeError):
            canonical.canonical_rows(spark.createDataFrame([], f"x {kind}"))


def test_digests(spark):
    rows = [(i % 37, f"t{i % 37}" if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string")
    whole = canonical.table_digest(df)
    assert whole == canonical.table_digest(df.repartition(7)) == canonical.table_digest(df.select("b", "a").orderBy("b"))
    assert whole != canonical.table_digest(df.limit(399)) and whole != canonical.table_digest(df.unionByName(df.limit(1)))
    small = [canonical.table_digest(df.repartition(n), bucket=2) for n in (1, 5)]
    assert small[0] == small[1] and canonical.table_digest(df.limit(0)) == canonical.table_digest(df.limit(0).repartition(3))


def test_populations(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (" ",), (None,)], "id string")
    assert sorted((tuple(r) for r in canonical.population_problems(ids, "id").collect()), key=str) == [("blank", " "), ("blank", None), ("repeated", "b")]
    assert canonical.population_digest(ids.limit(2), "id", "event-1") != canonical.population_digest(ids.limit(2), "id", "event-2")
    with pytest.raises(ValueError):
        canonical.population_digest(ids, "id", "Event 1")
