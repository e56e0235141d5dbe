import pytest
from pyspark.sql import functions as F

from cohortlens.llm import shards


def rows(df):
    return sorted(map(str, df.collect()))


def test_compaction_keeps_rows_and_every_version(spark, docs, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "store"))
    first = store.append(docs.where("doc_id < 100"), batch_rows=4)
    store.append(docs.where("doc_id >= 100"), batch_rows=4)
    target = 64 << 10
    old = store.manifest(2)
    assert (first, store.version()) == (1, 2) and old.count() == len({r.doc_id // 4 for r in docs.collect()})
    assert store.compact(target, 4) == 3
    new = store.manifest()
    assert new.count() < old.count()
    assert rows(store.read().select("row.*")) == rows(docs) == rows(store.read(2).select("row.*"))
    assert rows(store.read(1).select("row.*")) == rows(docs.where("doc_id < 100"))
    sums = store.read().groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    assert rows(sums) == rows(new.select("shard_id", "n_rows", "n_bytes"))


def test_runs_are_of_one_tier_and_about_the_target(spark, docs, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "store"))
    store.append(docs, batch_rows=2)
    size = {r.shard_id: r.n_bytes for r in store.manifest().collect()}
    by = {}
    for r in store.plan(64 << 10, 4).collect():
        by.setdefault(r.run, []).append(size[r.shard_id])
    assert by and all(len(v) > 1 and sum(v) < (64 << 10) + max(v) and max(v) <= 4.001 * min(v) for v in by.values())


def test_two_writers_conflict(spark, docs, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "store"))
    store.append(docs.limit(5))
    with pytest.raises(shards.Conflict):
        store.commit(store.manifest(), 1)
    assert store.version() == 1


def test_sharding_of_odd_rows(spark, odd, none, tmp_path):
    store = shards.compacted(odd, str(tmp_path / "odd"), batch_rows=2, target_bytes=1 << 20, fanout=2)
    assert rows(store.read().select("row.*")) == rows(odd)
    assert shards.placement(store).count() == odd.count()
    empty = shards.compacted(none, str(tmp_path / "none"))
    assert empty.version() == 1 and empty.manifest().count() == 0 and shards.placement(empty).count() == 0


def test_one_of_two_racing_writers_commits(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "race"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert store.append(docs) == 1
    old = store.manifest(1)
    assert store.commit(old, 2) == 2
    with pytest.raises(shards.Conflict):  # it has looked before the other committed
        store.commit(old.where("false"), 2)
    assert store.version() == 2 and store.manifest().count() == old.count()
    (tmp_path / "race/manifest/v-3").touch()
    assert store.version() == 2


def test_ids_may_be_text(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, None), ("b", "y")], "doc_id string, text string")
    store = shards.compacted(docs, str(tmp_path / "text"), batch_rows=2)
    assert sorted((r.doc_id or "", r.row.text or "") for r in store.read().collect()) == [("", ""), ("a", "x"), ("b", "y"), ("b", "y")]
