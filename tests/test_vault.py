"""The vault's receipts by hand, and the same when the stream is played again."""

import datetime as dt
import hashlib

import pytest

from cohortlens.streaming import vault

SCHEMA = "ref string, ts timestamp, seq long, action string, source string, subject string, payload binary, ttl long, reason string"
T = dt.datetime(2026, 1, 1)


def at(minutes, seq, ref, action, payload=None, ttl=3600, source="s", subject="p", reason=None):
    return ref, T + dt.timedelta(minutes=minutes), seq, action, source, subject, payload, ttl, reason


BATCHES = [
    [
        at(0, 1, "a", "capture", b"one"), at(1, 2, "a", "read"), at(2, 3, "a", "read", subject="other"), at(3, 4, "a", "capture", b"one"), at(4, 5, "a", "capture", b"two"), at(5, 6, "a", "delete"), at(6, 7, "a", "delete", reason="reviewed"), at(7, 8, "a", "read"), at(8, 9, "a", "capture", b"one"),
        at(0, 10, "b", "capture", b"bee", ttl=600), at(11, 11, "b", "read"), at(0, 12, "c", "capture", b"sea", ttl=1800), at(1, 13, "d", "read"),
        at(1, 14, "e", "capture", b""), at(1, 15, "e", "capture", b"x", ttl=0), at(1, 16, "e", "capture", b"x", ttl=86401), at(1, 17, "e", "capture", b"x" * 262_145), at(1, 18, "e", "capture", b"x", ttl=None), at(1, 19, "e", "look"), at(1, 20, None, "read"), at(1, 21, "e", None),
    ],
    [at(120, 30, "z", "capture", b"zed", ttl=86400)],
    [at(121, 31, "c", "read"), at(122, 32, "z", "read")],
]


def played(spark, folder, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    vault.receipts(stream).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(vault.RECEIPT).parquet(f"{folder}/{name}").collect()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    found = tmp_path_factory.mktemp("vault")
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{found}/in/{i}")
    return found


def test_receipts(spark, folder):
    rows = played(spark, folder, "once")
    by_seq = {r["seq"]: r["outcome"] for r in rows if r["seq"] is not None}
    assert by_seq == {
        1: "captured", 2: "read", 3: "refused", 4: "replayed", 5: "changed", 6: "invalid", 7: "deleted", 8: "gone", 9: "gone", 10: "captured", 11: "gone", 12: "captured", 13: "unknown",
        14: "invalid", 15: "invalid", 16: "invalid", 17: "invalid", 18: "invalid", 19: "invalid", 20: "invalid", 21: "invalid", 30: "captured", 31: "gone", 32: "read",
    }
    assert {(r["ref"], r["ts"]) for r in rows if r["outcome"] == "expired"} == {("b", T + dt.timedelta(minutes=10)), ("c", T + dt.timedelta(minutes=30))}
    assert {(r["seq"], bytes(r["payload"])) for r in rows if r["payload"] is not None} == {(2, b"one"), (32, b"zed")}
    assert {r["digest"] for r in rows if r["ref"] == "c"} == {hashlib.sha256(b"sea").hexdigest()}


def test_a_replay_gives_the_same_receipts(spark, folder):
    assert sorted(map(str, played(spark, folder, "again"))) == sorted(map(str, played(spark, folder, "third")))
