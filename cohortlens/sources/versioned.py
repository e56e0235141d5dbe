"""A keyed table in versions: upserts copy the buckets that they touch and leave all others where they are.

Rows are dealt over a fixed number of buckets by a hash of their key, which is unique, so buckets are alike in size. A version is a
small file that names the folder of each bucket; it is created without overwriting, so of two writers that began at one version
one gets a :class:`Stale` and begins again. Readers see whole versions. An upsert compares what it is given with the rows in the same
buckets first: rows that are there already change nothing, so a replay makes no version and rewrites no bucket.

Choose ``buckets`` so that one is the work of a task (a few hundred MB): the driver holds their folders and no rows. A writer that died
between creating and filling its file leaves an empty one, which ``recover`` takes away; its data folder is never read.

Defined results: null is a key like others; a key that an upsert gives twice is an error; an empty upsert makes no version.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from cohortlens.operators.staging import stored

BUCKETS = 64


class Stale(RuntimeError):
    """The table has gone on since the version that a writer began at."""


def _comparable(df: DataFrame, columns: list[str]) -> Column:
    """A row as a struct that can be compared: maps as sorted entries."""
    return F.struct(*[(F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, MapType) else F.col(c)).alias(c) for c in columns])


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self) -> dict[int, int]:
        """Version to its file's length."""
        at = self._path(f"{self.root}/versions")
        return {int(s.getPath().getName()): s.getLen() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max([0, *(v for v, n in self._files().items() if n)])

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that holds rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0])["buckets"].items()}

    def _schema(self, version: int) -> str:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0])["schema"]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the table has no version")
        schema = StructType.fromJson(json.loads(self._schema(version)))
        found = [f for b, f in self.folders(version).items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def recover(self) -> None:
        """Take away the file of a writer that died before it was filled."""
        for version, size in self._files().items():
            if not size:
                self._fs.delete(self._path(f"{self.root}/versions/{version}"), False)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same(self, a: str, b: str) -> Column:
        return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys])

    def _commit(self, rows: DataFrame, kept: dict[int, str], version: int) -> int:
        """Write rows by their bucket and make them, with the folders kept, the next version."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        schema = rows.schema.json()
        rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        new = {int(name.partition("=")[2]): f"{folder}/{name}" for name in there if name.startswith("_bucket=")}
        try:
            out = self._fs.create(self._path(f"{self.root}/versions/{version}"), False)
        except Py4JJavaError as e:
            raise Stale(f"version {version} is taken") from e
        out.write(bytearray(json.dumps({"schema": schema, "buckets": kept | new}).encode()))
        out.close()
        return version

    def create(self, rows: DataFrame) -> int:
        if self.version():
            raise Stale("the table is there already")
        return self._commit(self._unique(rows), {}, 1)

    def _unique(self, rows: DataFrame) -> DataFrame:
        twice = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        if twice:
            raise ValueError(f"the key {tuple(twice)[:-1]} is given {twice['n']} times")
        return rows

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """Put ``rows`` in place of those of the same keys; the version in which they are. ``base`` is the version that they were made from."""
        version = self.version()
        if base is not None and base != version:
            raise Stale(f"version {base} was read, {version} is there")
        columns = self.read(version).columns
        given = stored(rows.select(*columns).withColumn("_b", self._bucket()), "upsert")
        self._unique(given)
        near = [r[0] for r in given.select("_b").distinct().collect()]  # as many as buckets at most
        before = self.read(version, near)
        old = before.select(_comparable(before, columns).alias("old"), *self.keys).alias("o")
        given = given.withColumn("_given", _comparable(given, columns))
        equal = F.col("old").eqNullSafe(F.col("_given"))
        changed = given.alias("g").join(old, self._same("g", "o"), "left").where(F.col("old").isNull() | ~equal).select("g.*").drop("_given")
        changed = stored(changed, "changed")
        touched = [r[0] for r in changed.select("_b").distinct().collect()]
        if not touched:
            return version
        folders = self.folders(version)
        kept = self.read(version, touched).alias("k").join(changed.select(*self.keys).alias("c"), self._same("k", "c"), "left_anti")
        return self._commit(kept.unionByName(changed.drop("_b")), {b: f for b, f in folders.items() if b not in touched}, version + 1)
