"""Operator 1: sharding with size-tiered compaction and versioned manifests, in DataFrame operations alone.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifest/v-N`` names the folder with the list of the
live shards of version N. ``append`` writes arrivals as many small shards in one job, ``compact`` merges runs of
similarly sized shards into files of about the target size, and each ends in a commit: the next manifest is written
under a name of its own, and then the file ``v-N+1`` that names it is created without overwriting, which fails if another
writer has taken that version (one atomic step on HDFS and in stores that create conditionally; a local file system checks
and then creates). Readers see whole versions only; files of a failed attempt, and a name without a manifest in it, are
never read.

Tiers: a shard of ``b`` bytes is in tier ``floor(log(b) / log(fanout))``. A tier is cut into blocks of about ``BLOCK``
shards by a hash, so that no task holds a whole tier; within a block, shards in arrival order are cut into runs of about the target size; runs of a single shard, and tiers of fewer than ``fanout`` shards, stay as
they are, as does whatever has reached the target. Compaction repeats while it finds runs, so each row is rewritten
at most once per tier it climbs, and once where arrivals are alike.

Rows are kept whole in one struct column beside the keys, so columns of any name pass through. Sizes count the text
in UTF-8 bytes plus 8 for the key. Arrivals: an arrival is ``batch_rows`` consecutive doc_ids (null ids are one
arrival of their own; ids that aren't numbers are dealt to arrivals of that size by a hash); a batch with a hot or huge arrival is written by several tasks, as several files of the same
shard.

Defined results: null text counts 0 bytes; repeated rows are kept; an empty table commits an empty version.
"""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortlens.llm import common

BATCH_ROWS = 1024
FANOUT = 4
TARGET_BYTES = 32 << 20
#: Plan rows (shard to run) that are sent to all tasks; a larger plan is joined by shuffle.
PLAN_ROWS = 500_000
#: Shards of a tier that are planned together.
BLOCK = 4096
#: The most tasks that write merged shards; more runs share them evenly.
TASKS = 20_000
MANIFEST = "shard_id string, version int, level int, n_rows long, n_bytes long, path string"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 for a new store."""
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return 0
        # A writer that died between creating and filling its file has left an empty one.
        return max([0, *(int(s.getPath().getName()[2:]) for s in self._fs.listStatus(at) if s.getPath().getName().startswith("v-") and s.getLen())])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        folder = self.spark.read.text(f"{self.root}/manifest/v-{version}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/lists/{folder}")

    def commit(self, shards: DataFrame, version: int) -> int:
        """Make ``shards`` the live ones of ``version``; readers see all of them or none."""
        folder = uuid.uuid4().hex
        shards.select(*[F.col(f.name) for f in self.manifest(0).schema]).write.parquet(f"{self.root}/lists/{folder}")
        try:
            out = self._fs.create(self._path(f"{self.root}/manifest/v-{version}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {version}: {e.java_exception}") from e
        out.write(bytearray(folder.encode()))
        out.close()
        return version

    def _written(self, rows: DataFrame, folder: str) -> DataFrame:
        """Write rows by their column ``shard_id``; what was written, by shard, from the files themselves."""
        path = f"{self.root}/data/{folder}"
        rows.write.partitionBy("shard_id").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        sums = back.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        return common.stored(sums.withColumn("path", F.concat(F.lit(f"{path}/shard_id="), "shard_id")), "written")

    def append(self, docs: DataFrame, batch_rows: int = BATCH_ROWS) -> int:
        """Add each arrival of ``docs`` as a small shard; one commit."""
        version = self.version() + 1
        if isinstance(docs.schema["doc_id"].dataType, NumericType):
            number = F.floor(F.col("doc_id") / batch_rows)
        else:
            number = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // batch_rows)))
        arrival = F.when(F.col("doc_id").isNotNull(), number.cast("string")).otherwise("none")
        rows = docs.select(
            F.format_string("a%05d-%s", F.lit(version), arrival).alias("shard_id"), F.col("doc_id").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("n_bytes"), F.struct(*[common.col(docs, c) for c in docs.columns]).alias("row"),
        )
        new = self._written(rows, f"append-{uuid.uuid4().hex}").withColumns({"version": F.lit(version), "level": F.lit(0)})
        return self.commit(self.manifest(version - 1).unionByName(new), version)

    def plan(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """``shard_id, run`` of the shards to merge."""
        tier = F.floor(F.log(F.greatest("n_bytes", F.lit(1))) / math.log(fanout))
        small = self.manifest().where(F.col("n_bytes") * 2 <= target_bytes).withColumn("tier", tier)
        sizes = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fanout)  # a row for each tier
        small = small.join(F.broadcast(sizes), "tier").withColumn("block", F.pmod(F.xxhash64("shard_id"), F.ceil(F.col("n") / BLOCK)))
        order = Window.partitionBy("tier", "block").orderBy("shard_id").rowsBetween(Window.unboundedPreceding, 0)
        placed = small.withColumn("run", F.floor((F.sum("n_bytes").over(order) - F.col("n_bytes")) / target_bytes))
        placed = placed.withColumn("merge", F.count(F.lit(1)).over(Window.partitionBy("tier", "block", "run")) > 1).where("merge")
        return placed.select("shard_id", F.format_string("t%02d-%04d-%06d", "tier", "block", "run").alias("run"), "level", "path")

    def compact(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge the planned runs and commit; the version, unchanged where there is nothing to merge."""
        old = self.version()
        plan = common.stored(self.plan(target_bytes, fanout), "plan")
        n = plan.count()
        if not n:
            return old
        version = old + 1
        # A row for each merged shard: 3 million of them in 100 TB are numbered in one task.
        runs = plan.groupBy("run").agg(F.max("level").alias("level")).withColumn("number", F.row_number().over(Window.orderBy("run")) - 1)
        runs = common.stored(runs, "runs")
        tasks = min(runs.count(), TASKS)
        folders = [r[0] for r in plan.select(F.regexp_replace("path", "/shard_id=[^/]*$", "")).distinct().collect()]
        schema = self.spark.read.parquet(folders[0]).schema
        rows = self.spark.read.schema(schema).parquet(folders[0])
        for folder in folders[1:]:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(folder))
        chosen = plan.select("shard_id", "run").join(runs.select("run", "number"), "run")
        merged = rows.join(F.broadcast(chosen) if n <= PLAN_ROWS else chosen, "shard_id")
        name = F.format_string("m%05d-%s", F.lit(version), F.col("run"))
        # A run is of bounded size: one task and one file each, dealt by number, however the keys of its rows are spread.
        merged = merged.repartitionById(tasks, (F.col("number") % tasks).cast("int")).select(name.alias("shard_id"), "doc_id", "n_bytes", "row")
        new = self._written(merged, f"merge-{uuid.uuid4().hex}")
        new = new.join(runs.select(name.alias("shard_id"), (F.col("level") + 1).alias("level")), "shard_id").withColumn("version", F.lit(version))
        kept = self.manifest(old).join(plan.select("shard_id"), "shard_id", "left_anti")
        return self.commit(kept.unionByName(new), version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their shard: shard_id, doc_id, n_bytes, row."""
        live = self.manifest(version).select("shard_id", "path")
        folders = [r[0] for r in live.select(F.regexp_replace("path", "/shard_id=[^/]*$", "")).distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], "shard_id string, doc_id long, n_bytes long, row struct<>")
        frames = [self.spark.read.schema(self.spark.read.parquet(f).schema).parquet(f) for f in folders]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows.join(live.select("shard_id"), "shard_id", "left_semi")


def compacted(docs: DataFrame, root: str | None = None, batch_rows: int = BATCH_ROWS, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """A store with ``docs`` appended and compacted until no run is left to merge."""
    store = ShardStore(docs.sparkSession, root or common.new_path(docs.sparkSession, "shards"))
    version = store.append(docs, batch_rows)
    while (newer := store.compact(target_bytes, fanout)) != version:
        version = newer
    return store


def placement(store: ShardStore) -> DataFrame:
    """Where each row is: doc_id, shard_id, its size, and the shard's level, rows and bytes in the newest version."""
    about = store.manifest().select("shard_id", "version", "level", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
    return store.read().select("doc_id", "shard_id", "n_bytes").join(about, "shard_id").select("doc_id", "n_bytes", "shard_id", "version", "level", "shard_rows", "shard_bytes")
