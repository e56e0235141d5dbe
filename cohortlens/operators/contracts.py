"""Contract validators as queries that must return no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.suppress import small


def count_violations(cells: DataFrame, k: int) -> DataFrame:
    """Published values are zero or at least k; withheld ones are null."""
    published = F.col("privacy") == "published"
    return cells.where((published & (F.col("value").isNull() | small(k, F.col("value")))) | (~published & F.col("value").isNotNull()))


def funnel_violations(stages: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """Stages (place, n) of a funnel never grow, and never drop by one to k - 1."""
    drop = F.lag("n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("place")) - F.col("n")  # a row for each stage: few
    return stages.withColumn("drop", drop).where((F.col("drop") < 0) | small(k, F.col("drop")))


def flow_violations(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """What flows out of or into a node is at most the node. ``links``: source, target, n; ``nodes``: node, size."""
    out = links.groupBy(F.col("source").alias("node")).agg(F.sum("n").alias("flow")).withColumn("side", F.lit("out"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.sum("n").alias("flow")).withColumn("side", F.lit("in"))
    return out.unionByName(into).join(nodes, "node", "left").where("size is null or flow > size")


def rectangle_violations(cells: DataFrame, row: str, column: str, wanted: int) -> DataFrame:
    """Rows that don't have each of the ``wanted`` columns exactly once."""
    found = cells.groupBy(row).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("kinds"))
    return found.where((F.col("n") != wanted) | (F.col("kinds") != wanted))


def reference_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def selection_violations(outcomes: DataFrame, by: list[str], total: str, k: int) -> DataFrame:
    """Outcomes of a selection (``value``, null where withheld) add up to ``total``; none is withheld alone or can be worked out."""
    sums = outcomes.groupBy(*by).agg(F.count_if(F.col("value").isNull()).alias("withheld"), F.coalesce(F.sum("value"), F.lit(0)).alias("known"), F.max(total).alias("total"))
    rest = F.col("total") - F.col("known")
    problem = F.when(F.col("withheld") == 1, "single_withheld").when((F.col("withheld") == 0) & (rest != 0), "sum").when((F.col("withheld") > 0) & ((rest < 0) | small(k, rest)), "remainder")
    return sums.select(*by, problem.alias("problem")).where("problem is not null")


def dimension_violations(items: DataFrame, by: list[str], known: str, denominator: str | None = None, mode: str | None = None, item: str | None = None) -> DataFrame:
    """The first problem of each dimension.

    ``known`` must be published and within the denominator, and no item's ``value`` (null where withheld) may be above it. The items of an exclusive
    dimension (all are, where no ``mode`` is named) add up to it, or to no more where some are withheld, and none is withheld alone.
    An item may not come twice, where its column is named.
    """
    whole = F.max(denominator) if denominator else F.max(known)
    twice = (F.count(item) - F.count_distinct(item)) if item else F.lit(0)
    sums = items.groupBy(*by).agg(
        F.count_if(F.col("value").isNull()).alias("withheld"), F.coalesce(F.sum("value"), F.lit(0)).alias("sum"), F.coalesce(F.max("value"), F.lit(0)).alias("most"), F.max(known).alias("known"),
        F.bool_or(F.col(known).isNull()).alias("hidden"), whole.alias("whole"), (F.min(mode) if mode else F.lit("exclusive")).alias("mode"), twice.alias("twice"),
    )
    exclusive = F.col("mode") == "exclusive"
    problem = (
        F.when(F.col("hidden") | F.col("whole").isNull() | (F.col("known") > F.col("whole")), "known").when(F.col("most") > F.col("known"), "item").when(F.col("twice") > 0, "repeated")
        .when(~F.coalesce(F.col("mode").isin("exclusive", "overlapping"), F.lit(False)), "mode").when(exclusive & ((F.col("withheld") == 0) & (F.col("sum") != F.col("known")) | (F.col("sum") > F.col("known"))), "sum")
        .when(exclusive & (F.col("withheld") == 1), "single_withheld")
    )
    return sums.select(*by, problem.alias("problem")).where("problem is not null")


def intersection_violations(intersections: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Intersections (``key``, components, value) have two components or more, each once, all of them items (component, value); none is above its smallest or published over a withheld one."""
    parts = intersections.select(key, "value", F.explode_outer("components").alias("component")).join(items.select("component", F.lit(True).alias("there"), F.col("value").alias("part")), "component", "left")
    sums = parts.groupBy(key).agg(
        F.max("value").alias("value"), F.count("component").alias("all"), F.count_distinct("component").alias("n"), F.count_if(F.col("there").isNull()).alias("unknown"), F.count_if(F.col("there") & F.col("part").isNull()).alias("withheld"), F.min("part").alias("least")
    )
    problem = (
        F.when(F.col("all") > F.col("n"), "repeated").when(F.col("n") < 2, "components").when(F.col("unknown") > 0, "unknown").when(F.col("value").isNotNull() & (F.col("withheld") > 0), "over_withheld").when(F.col("value") > F.col("least"), "count")
    )
    return sums.select(key, problem.alias("problem")).where("problem is not null")


def journey_violations(links: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(source, target, node, problem)``: the first problem of each link, and of each node's links together.

    ``links``: source, target, n; ``nodes``: node, place, size; n and size are null where withheld. A link joins two known nodes, forward in place,
    once; it is no larger than either, and no published nodes that it joins differ by one to k - 1. What flows out of or into a published
    node is at most the node; of two or more links out of it none is withheld alone, and what withheld ones hold isn't one to k - 1.
    """
    end = lambda side: nodes.select(F.col("node").alias(side), F.col("place").alias(f"{side}_place"), F.col("size").alias(f"{side}_size"), F.lit(True).alias(f"{side}_there"))
    found = links.groupBy("source", "target").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times")).join(end("source"), "source", "left").join(end("target"), "target", "left")
    problem = (
        F.when(F.col("source_there").isNull() | F.col("target_there").isNull(), "unknown_node").when(F.col("source") == F.col("target"), "self").when(F.col("source_place") >= F.col("target_place"), "backward")
        .when(F.coalesce(F.col("n") > F.col("source_size"), F.lit(False)) | F.coalesce(F.col("n") > F.col("target_size"), F.lit(False)), "endpoint")
        .when(F.col("n").isNotNull() & small(k, F.col("source_size") - F.col("target_size")), "nested_remainder").when(F.col("times") > 1, "repeated")
    )
    by_link = found.select("source", "target", F.lit(None).cast(nodes.schema["node"].dataType).alias("node"), problem.alias("problem"))
    sums = lambda side, name: links.groupBy(F.col(side).alias("node")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name), F.count(F.lit(1)).alias(f"{name}_links"), F.count_if(F.col("n").isNull()).alias(f"{name}_withheld"))
    flows = nodes.where("size is not null").join(sums("source", "out"), "node", "left").join(sums("target", "into"), "node", "left")
    wrong = (
        F.when((F.col("out_links") >= 2) & (F.col("out_withheld") == 1), "single_withheld").when((F.col("out_withheld") > 0) & small(k, F.col("size") - F.col("out")), "withheld_remainder")
        .when(F.col("out") > F.col("size"), "outgoing").when(F.col("into") > F.col("size"), "incoming")
    )
    none = F.lit(None).cast(links.schema["source"].dataType)
    by_node = flows.select(none.alias("source"), none.alias("target"), "node", wrong.alias("problem"))
    return by_link.unionByName(by_node).where("problem is not null")


def artifact_violations(artifacts: DataFrame, k: int) -> DataFrame:
    """``present`` of ``eligible`` artifacts: no more than these, none to k - 1 missing, and ``complete`` says whether all are there."""
    rest = F.col("eligible") - F.col("present")
    problem = F.when(rest < 0, "present").when(small(k, rest), "complement").when(F.col("complete") != (rest == 0), "status")
    return artifacts.withColumn("problem", problem).where("problem is not null")
