"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="cohortlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage and survives a lost executor.

    ``tidy``: the shuffle files behind it go once it is written, not when the driver happens to collect its garbage.
    """
    path, conf, cleanup = new_path(df.sparkSession, name), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    try:
        conf.set(cleanup, "true" if tidy else before)
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once a later table holds all that is still needed of it."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def col(df: DataFrame, name: str) -> Column:
    """A top-level column, also where its name holds dots."""
    return df[f"`{name}`"]


def text_hash(text: Column) -> Column:
    """With doc_id the identity of a document: rows that agree in both are one document."""
    return F.xxhash64(text)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(rows, schema)


_held: dict = {}


def held(name, make: Callable):
    """What an operator keeps in its Python worker between tasks; a worker serves many stages, so others' is dropped."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column holds about ``limit`` bytes at most, at least a row each."""
    for batch in batches:
        n = batch.num_rows
        per_row = max(1, batch.column(column).nbytes // max(n, 1))
        step = max(1, limit // per_row)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def spans(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows of these sizes into ``[start, stop)`` runs of about ``limit``, at least a row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
