"""Who is in a population: stage tests, answers, exclusions, set comparisons, and orders of processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage(match: str, field: Column | None = None, accepted: list[str] = ()) -> Column:
    """Whether a row reaches a funnel stage: any row, a value of a list whatever its case, or a field that isn't blank."""
    text = F.trim(F.coalesce(field.cast("string"), F.lit(""))) if field is not None else F.lit("")
    if match == "any_row":
        return F.lit(True)
    if match == "value_in":
        return F.lower(text).isin(*[a.lower() for a in accepted])
    if match == "non_empty":
        return text != ""
    raise ValueError(f"unknown match {match!r}")


def answer(asked: Column, value: Column) -> Column:
    """A question's state: not asked, empty, or answered with a value."""
    text = F.trim(F.coalesce(value, F.lit("")))
    state = F.when(~asked, "question_not_present").when(text == "", "empty").otherwise("answered")
    return F.struct(state.alias("state"), F.when(state == "answered", text).alias("value"))


def related(rows: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``outcome``: kept, or ``invalid_relation`` where the key isn't in the population; none vanishes."""
    known = population.select(key).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, key, "left").withColumn("outcome", F.when(F.col("_in"), "kept").otherwise("invalid_relation")).drop("_in")


def exclusion(known: DataFrame, excluded: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(remaining, unknown)``: the known subjects that stay, and exclusions of nobody, which must be none."""
    return known.join(excluded.select(key), key, "left_anti"), excluded.select(key).distinct().join(known.select(key), key, "left_anti")


def compared(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """By key what differs between two populations: missing, unexpected, or repeated."""
    side = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = side(expected, "expected").join(side(observed, "observed"), key, "full").fillna(0, ["expected", "observed"])
    problem = F.when(F.col("observed") == 0, "missing").when(F.col("expected") == 0, "unexpected").when((F.col("observed") > 1) | (F.col("expected") > 1), "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def membership(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """By key which of the named populations it is in, as booleans."""
    marked = [df.select(key).distinct().withColumn("_side", F.lit(name)) for name, df in sides.items()]
    flags = [F.coalesce(F.bool_or(F.col("_side") == name), F.lit(False)).alias(name) for name in sides]
    return reduce(DataFrame.unionByName, marked).groupBy(key).agg(*flags)


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each group with the smallest ``order``, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m")).select(*keys, *[f"_m.{c}" for c in (order, *rest)])


def top_roles(roles: DataFrame, by: str, current: Column, year: str, place: str, k: int = 6) -> DataFrame:
    """A person's current roles first, then the latest start (no year last), stable by place."""
    order = Window.partitionBy(by).orderBy(F.when(current, 0).otherwise(1), F.coalesce(year, F.lit(0)).desc(), place)
    return roles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rich_projects(projects: DataFrame, by: str, engagement: str, recency: str, place: str, k: int = 3) -> DataFrame:
    """The two with most engagement (then latest), the two latest (then with most engagement), then all by engagement: the first ``k`` of these, each once; at last by place."""
    ranked = lambda c, then: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), F.desc(then), place))
    found = projects.withColumn("_e", ranked(engagement, recency)).withColumn("_r", ranked(recency, engagement))
    turn = F.when(F.col("_e") <= 2, F.col("_e")).when(F.col("_r") <= 2, F.col("_r") + 2).otherwise(F.col("_e") + 4)
    # Of those behind the first two of either order only the first k by engagement can be chosen.
    found = found.where((F.col("_e") <= 2 + k) | (F.col("_r") <= 2)).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(turn)))
    return found.where(F.col("rank") <= k).drop("_e", "_r")


def processing_priority(present: Column, accepted: Column) -> Column:
    return F.when(present, 0).when(accepted, 1).otherwise(2)


def review_ordinal(by: list[str], *order) -> Column:
    """``candidate-0001`` and so on within a group."""
    return F.format_string("candidate-%04d", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
