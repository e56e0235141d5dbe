"""Counts over populations: states, registered metrics, taxonomy cells, nested cohorts, exact regions, matrices.

Every aggregate is one pass with partial aggregation; registries (metrics, states, regions) are arrays of literals that
each row is matched with, so no row is multiplied by more than a registry's size and cells without rows still appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.predicates import COHORTS, GROUPS, METRICS, REGIONS, SIGNALS, STATES, compiled


def unpivoted(row: DataFrame, keys: list[str], by: list[str], key: str = "cell", value: str = "n") -> DataFrame:
    """One wide row of counts per group as a row for each count."""
    pairs = F.array(*[F.struct(F.lit(k).alias(key), F.coalesce(F.col(k), F.lit(0)).cast("long").alias(value)) for k in keys])
    return row.select(*by, F.explode(pairs).alias("_x")).select(*by, f"_x.{key}", f"_x.{value}")


def counted(df: DataFrame, cells: dict[str, Column], by: list[str]) -> DataFrame:
    return unpivoted(df.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in cells.items()]), list(cells), by)


def in_cohorts(facts: DataFrame) -> DataFrame:
    """A row for each cohort that a person is in: all, accepted, attended."""
    names = F.array(F.lit(COHORTS[0]), F.when(F.col("accepted"), COHORTS[1]), F.when(F.col("present"), COHORTS[2]))
    return facts.withColumn("cohort", F.explode(F.array_compact(names)))


def assessed() -> Column:
    return F.col("assessment_state") == "assessed"


def metric_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    return counted(facts, {k: assessed() & compiled(p) for k, p in METRICS.items()}, by)


def metric_keys() -> Column:
    """The metrics that a row satisfies, sorted."""
    return F.array_compact(F.array(*[F.when(assessed() & compiled(p), k) for k, p in sorted(METRICS.items())]))


def state_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    """The six states, and total, eligible and unknown as they follow from them."""
    state = F.col("assessment_state")
    cells = {s: state == s for s in STATES} | {"total": F.lit(True), "eligible": state != "excluded", "unknown": ~state.isin("excluded", "assessed")}
    return counted(facts, cells, by)


def exclusive_counts(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """By dimension and value; eligible people who aren't assessed are unknown."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.when(assessed(), F.coalesce(d, F.lit("unknown"))).otherwise("unknown").alias("cell")) for d in dimensions])
    rows = facts.where("assessment_state <> 'excluded'").select(F.explode(cells).alias("x"))
    return rows.groupBy("x.dimension", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def overlapping_counts(people: DataFrame, labels: str) -> DataFrame:
    """By label of an array column; unknown: people whose array is empty or null."""
    known = F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0
    return people.select(F.explode(F.when(known, F.array_distinct(labels)).otherwise(F.array(F.lit("unknown")))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def group_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    """Unions of neighbouring tiers of a dimension."""
    return counted(facts, {k: assessed() & F.col(d).isin(*v) for k, (d, v) in GROUPS.items()}, by)


def exact_regions(people: DataFrame) -> DataFrame:
    """The eight regions of three signals; they add up to the population."""
    same = lambda wanted: (F.col(SIGNALS[0]) == wanted[0]) & (F.col(SIGNALS[1]) == wanted[1]) & (F.col(SIGNALS[2]) == wanted[2])
    return counted(people, {k: same(w) for k, w in REGIONS.items()}, [])


def region_marginals(regions: DataFrame) -> DataFrame:
    """Each signal's total and complement, from the regions alone."""
    sides = [F.struct(F.lit(s).alias("signal"), F.col("cell").isin([k for k, w in REGIONS.items() if w[i]]).alias("member"), F.col("n")) for i, s in enumerate(SIGNALS)]
    return regions.select(F.explode(F.array(*sides)).alias("x")).groupBy("x.signal").agg(F.sum(F.when(F.col("x.member"), F.col("x.n")).otherwise(0)).alias("n"), F.sum(F.when(~F.col("x.member"), F.col("x.n")).otherwise(0)).alias("complement"))


def matrix(df: DataFrame, row: str, flag: str) -> DataFrame:
    """By row value how many have the flag and how many don't."""
    return df.groupBy(row).agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("submitted"), F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("not_submitted"))
