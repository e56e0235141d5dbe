"""Tables written between the steps of an operator, and running totals over groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, and a lost executor costs one step.

    ``tidy``: the shuffle files behind it go once it is written, not when the driver happens to collect its garbage.
    """
    path, conf, cleanup = path or new_path(df.sparkSession, name), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    try:
        conf.set(cleanup, "true" if tidy else before)
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` with the sum (or ``min``, or ``xor``) of ``value`` over the rows of its group that come before it in ``order`` (unique in a group).

    No task holds a group: rows are dealt by range over group and order, and what a group's earlier parts come to, a row for
    each part and group, is added to what comes before within the part. Nulls in ``by`` are a group of their own; the sum of no
    rows is 0, and so is their xor; their minimum is null.
    """
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    total, both = {"sum": (F.sum, lambda a, b: zero(a) + zero(b)), "xor": (F.bit_xor, lambda a, b: zero(a).bitwiseXOR(zero(b))), "min": (F.min, F.least)}[how]
    dealt = df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "running")
    parts = dealt.groupBy(*by, "_part").agg(total("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), total("_total").over(before).alias("_before"))
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_within", total("_value").over(within))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return placed.join(parts, same).select(*df.columns, both(F.col("_within"), F.col("_before")).alias(name))
