"""Connected components of links by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common


def _large(links: DataFrame) -> DataFrame:
    """Point each node's larger neighbours at the smallest node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """Point each node, and its smaller neighbours, at the smallest of these."""
    centre = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(centre.select("u", F.col("m").alias("v"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node with a smaller one has that alone, and none below itself."""
    end = lambda node, down: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = links.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(u, v)``: the component is its smallest node.

    Nodes may be of any type that Spark orders. Each step is written to the shared folder, so that neither the
    plan nor what a lost executor costs grows with the steps; the steps number about the log of the diameter.
    """
    links = common.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(links):
        links = common.stored(_small(_large(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
