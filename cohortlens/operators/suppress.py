"""Disclosure control as DataFrame operators over long cell tables.

Each rule takes cells (partition columns ``by``, a cell key ``cell`` and a count ``n``) and the threshold ``k``, and
adds ``value`` (the count, null where withheld) and ``privacy``. The rules differ on purpose, above all on whether a
zero is sensitive, and are never merged. Cell tables are small (registries times cohorts), so windows over a partition
are cheap; suppression is always the last relational step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shown(cells: DataFrame, state: Column) -> DataFrame:
    """``state`` is null where the count is published, else why not."""
    return cells.withColumn("privacy", F.coalesce(state, F.lit("published"))).withColumn("value", F.when(F.col("privacy") == "published", F.col("n")))


def _when(condition: Column, why: str = "withheld") -> Column:
    return F.when(condition, why)


def small(k: int, n: Column | None = None) -> Column:
    n = F.col("n") if n is None else n
    return (n > 0) & (n < k)


def effective_k(eligible: Column, sensitive: Column, k: Column | None = None) -> Column:
    """D1: an explicit k of five or more holds; else ten where it is sensitive or the group is small, else five."""
    usual = F.when(sensitive | (eligible < 50), 10).otherwise(5)
    return usual if k is None else F.coalesce(k, usual)


def _complementary(cells: DataFrame, by: list[str], primary: Column, candidate: Column) -> DataFrame:
    """With exactly one primary cell the smallest candidate (ties by key) is withheld too."""
    part = Window.partitionBy(*by)
    place = F.row_number().over(part.orderBy(candidate.desc(), "n", "cell"))
    marked = cells.withColumns({"_p": primary, "_c": candidate})
    marked = marked.withColumns({"_n": F.sum(F.col("_p").cast("int")).over(part), "_r": place})
    state = F.when(F.col("_p"), "primary").when((F.col("_n") == 1) & F.col("_c") & (F.col("_r") == 1), "complementary")
    return _shown(marked.withColumn("_s", state), F.col("_s")).drop("_p", "_c", "_n", "_r", "_s")


def p1_distribution(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """Counts under k, zero included; a single one takes the smallest other with it."""
    return _complementary(cells, by, F.col("n") < k, F.col("n") >= k)


def p2_crosstab(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """A count under k, zero included, withholds the table."""
    return _shown(cells, _when(F.max(F.col("n") < k).over(Window.partitionBy(*by))))


def p3_point(cells: DataFrame, k: int) -> DataFrame:
    """Zero or k and more are published."""
    return _shown(cells, _when(small(k)))


def p4_nested(cells: DataFrame, parent: str, k: int) -> DataFrame:
    """As P3, and a drop from the parent of one to k - 1 is withheld."""
    return _shown(cells, _when(small(k) | small(k, F.col(parent) - F.col("n"))))


def p5_binary_violations(cells: DataFrame, total: str, k: int) -> DataFrame:
    """The selections of which either side is derivable; must be empty."""
    return cells.where(small(k) | small(k, F.col(total) - F.col("n")))


def p6_exclusive(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """Counts of one to k - 1; a single one takes the smallest of k and more with it, if there is any."""
    return _complementary(cells, by, small(k), F.col("n") >= k)


def p7_protected(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """A count of one to k - 1 withholds the partition, zeros too."""
    return _shown(cells, _when(F.max(small(k)).over(Window.partitionBy(*by))))


def p8_reviewed(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """Published only from k on, and only where no cell has one to k - 1."""
    return _shown(cells, _when((F.col("n") < k) | F.max(small(k)).over(Window.partitionBy(*by))))


def p9_unsafe(n: Column, denominator: Column, k: int) -> Column:
    return small(k, n) | small(k, denominator - n)


def p9_complement(cells: DataFrame, denominator: str, k: int) -> DataFrame:
    """Neither the count nor its complement may be one to k - 1."""
    return _shown(cells, _when(p9_unsafe(F.col("n"), F.col(denominator), k)))


def p10_closure(cells: DataFrame, by: list[str], denominator: str, k: int) -> DataFrame:
    """A cell withheld by P9, or a residual of one to k - 1 outside the cells, withholds the dimension."""
    part = Window.partitionBy(*by)
    residual = F.col(denominator) - F.sum("n").over(part)
    return _shown(cells, _when(F.max(p9_unsafe(F.col("n"), F.col(denominator), k)).over(part) | small(k, residual)))


def p11_subsets(cells: DataFrame, relations: DataFrame, by: list[str], k: int) -> DataFrame:
    """Where a broader cell exceeds a narrower one by one to k - 1, the broader is withheld.

    ``cells`` may hold an earlier ``privacy``; ``relations`` has ``broader`` and ``narrower``.
    """
    narrower = cells.select(*by, F.col("cell").alias("narrower"), F.col("n").alias("_n"))
    hit = cells.select(*by, "cell", "n").join(F.broadcast(relations), F.col("cell") == F.col("broader")).join(narrower, [*by, "narrower"])
    hit = hit.where(small(k, F.col("n") - F.col("_n"))).select(*by, "cell", F.lit(True).alias("_hit")).distinct()
    before = _when(F.col("privacy") != "published") if "privacy" in cells.columns else F.lit(None).cast("string")
    return _shown(cells.join(hit, [*by, "cell"], "left"), F.coalesce(before, _when(F.col("_hit")))).drop("_hit")


def p12_reviewed_complement(cells: DataFrame, reviewed: str, k: int) -> DataFrame:
    return _shown(cells, _when(small(k, F.col(reviewed) - F.col("n"))))


def p13_denominator(cells: DataFrame, eligible: str, total: str, k: int) -> DataFrame:
    """Where the eligible number itself is unsafe it is hidden, and counts are judged against the total."""
    unsafe = p9_unsafe(F.col(eligible), F.col(total), k)
    judged = F.when(unsafe, F.col(total)).otherwise(F.col(eligible))
    return _shown(cells, _when(p9_unsafe(F.col("n"), judged, k))).withColumn("denominator", F.when(~unsafe, F.col(eligible)))


def p14_cross_cohort(cells: DataFrame, ladder: list[str], by: list[str], k: int) -> DataFrame:
    """Raw drops of one to k - 1 between neighbouring cohorts mask the cell in both. ``ladder``: widest first.

    A cohort without a row has nobody in that cell: it counts as 0.
    """
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(ladder) for x in (c, i)])
    ranked = cells.withColumn("_rank", F.element_at(rank, F.col("cohort")))
    part = Window.partitionBy(*by, "cell")
    counts = F.array(*[F.coalesce(F.max(F.when(F.col("_rank") == i, F.col("n"))).over(part), F.lit(0)) for i in range(len(ladder))])
    up, down = F.get(counts, F.col("_rank") - 1) - F.col("n"), F.col("n") - F.get(counts, F.col("_rank") + 1)
    hit = F.coalesce(small(k, up), F.lit(False)) | F.coalesce(small(k, down), F.lit(False))
    before = _when(F.col("privacy") != "published") if "privacy" in cells.columns else F.lit(None).cast("string")
    return _shown(ranked.withColumn("_hit", hit), F.coalesce(before, _when(F.col("_hit")))).drop("_hit", "_rank")


def p15_partition(regions: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Any exact region of one to k - 1 withholds all of them."""
    return p7_protected(regions, by or [], k)
