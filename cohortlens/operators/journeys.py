"""The contract of journeys: nodes with counts, and what flows between them, as a query that must give no rows.

A count is null where it is withheld. What is withheld must not follow from what is published: not alone among the parts of a
published whole, and not with a remainder of 1 to k - 1. Nodes come as ``(journey, node, place, size)``, links as ``(journey, source,
target, n)``; other columns are left out. Every rule joins or groups by journey and node, so journeys are checked in parallel; a
journey has few nodes. Null keys belong to one journey, node or link of that key; repeated nodes, places and links are problems of
their own (and may cause others); a journey without links is sound, a link without its nodes is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.suppress import small

# The closed topologies of real journeys, as links, and the whole with its parts that must add up.
TOPOLOGIES = {
    "public": ([("applied", "going_accepted"), ("applied", "not_accepted_reason_unknown"), ("going_accepted", "on_site")], "applied", ["going_accepted", "not_accepted_reason_unknown"]),
    "operator": ([("approved", "checked_in"), ("checked_in", "team_path"), ("checked_in", "solo_path")], "checked_in", ["team_path", "solo_path"]),
}
ACCEPTED, NOT_ACCEPTED = ["going_accepted", "accepted"], "not_accepted"


def _withheld_parts(total: Column, n: Column, withheld: Column, published: Column, k: int) -> list[tuple[str, Column]]:
    """Rules of a published ``total`` with ``n`` parts."""
    known = total.isNotNull()
    return [("single withheld part", known & (n >= 2) & (withheld == 1)), ("small withheld remainder", known & (withheld > 0) & small(k, total - published))]


def _problems(df: DataFrame, where: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule that a row breaks; one that can't be decided, as counts are withheld, is not broken."""
    broken = F.array_compact(F.array(*[F.when(c, rule) for rule, c in rules]))
    return df.select("journey", where.alias("at"), F.explode(broken).alias("problem"))


def _link() -> Column:
    return F.concat(F.coalesce("source", F.lit("?")), F.lit("->"), F.coalesce("target", F.lit("?")))


def violations(nodes: DataFrame, links: DataFrame, k: int, real: bool = False) -> DataFrame:
    """``(journey, at, problem)``: every broken rule with the node or link it is broken at; ``real`` journeys must have a closed topology."""
    nodes, links = nodes.select("journey", "node", "place", "size"), links.select("journey", "source", "target", "n")
    doubled = lambda df, keys, at, what: df.groupBy("journey", *keys).count().where("count > 1").select("journey", at.alias("at"), F.lit(what).alias("problem"))
    found = [doubled(nodes, ["node"], F.col("node"), "doubled node"), doubled(nodes, ["place"], F.col("place").cast("string"), "doubled place"), doubled(links, ["source", "target"], _link(), "doubled link")]

    # A doubled node stands for one of them here; it is a problem already.
    one = nodes.groupBy("journey", "node").agg(F.min("place").alias("place"), F.min("size").alias("size"))
    side = lambda s: one.select(F.col("journey").alias(f"j_{s}"), F.col("node").alias(f"node_{s}"), F.col("place").alias(f"place_{s}"), F.col("size").alias(f"size_{s}"), F.lit(True).alias(f"known_{s}"))
    ends = links
    for s in ("source", "target"):
        ends = ends.join(side(s), F.col("journey").eqNullSafe(F.col(f"j_{s}")) & F.col(s).eqNullSafe(F.col(f"node_{s}")), "left")
    n, source, target = F.col("n"), F.col("size_source"), F.col("size_target")
    known = F.col("known_source").isNotNull() & F.col("known_target").isNotNull()
    rules = [
        ("unknown node", ~known), ("link to itself", F.col("source").eqNullSafe(F.col("target"))), ("not forward", (F.col("place_source") >= F.col("place_target")) & (F.col("source") != F.col("target"))),
        ("more than an end", (n > source) | (n > target)), ("small nested remainder", n.isNotNull() & small(k, source - target)),
    ]
    if real:
        rules.append(("not its target's count", known & ~n.eqNullSafe(target)))
    found.append(_problems(ends, _link(), rules))

    sums = lambda end: links.groupBy("journey", F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("links"), F.count_if(n.isNull()).alias("withheld"), F.coalesce(F.sum("n"), F.lit(0)).alias("flow"))
    for end, name, more in (("source", "outgoing", True), ("target", "incoming", False)):
        met = sums(end).alias("s").join(one.alias("o"), F.col("s.journey").eqNullSafe(F.col("o.journey")) & F.col("s.node").eqNullSafe(F.col("o.node"))).select("s.*", "size")
        rules = [(f"{name} above the node", F.col("flow") > F.col("size"))]
        found.append(_problems(met, F.col("node"), rules + (_withheld_parts(F.col("size"), F.col("links"), F.col("withheld"), F.col("flow"), k) if more else [])))

    is_other = F.col("node").startswith(NOT_ACCEPTED)
    accepted = [F.max(F.when(F.col("node") == a, F.struct(F.col("size").alias("size")))) for a in ACCEPTED]
    parts = one.groupBy("journey").agg(
        F.max(F.when(F.col("node") == "applied", F.col("size"))).alias("size"), F.coalesce(*accepted).alias("accepted"), F.count_if(is_other).alias("others"),
        F.count_if(is_other & F.col("size").isNull()).alias("withheld"), F.coalesce(F.sum(F.when(is_other, F.col("size"))), F.lit(0)).alias("published"),
    )
    parts = parts.where("accepted is not null and others > 0")
    withheld, published = F.col("withheld") + F.col("accepted.size").isNull().cast("int"), F.col("published") + F.coalesce("accepted.size", F.lit(0))
    found.append(_problems(parts, F.lit("applied"), _withheld_parts(F.col("size"), F.col("others") + 1, withheld, published, k)))
    if real:
        found += [_open_topologies(one, links), _unreconciled(one)]
    return reduce(DataFrame.unionByName, found)


def _open_topologies(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Journeys whose nodes and links are those of no topology."""
    names = {t: sorted({node for pair in pairs for node in pair}) for t, (pairs, _, _) in TOPOLOGIES.items()}
    keys = nodes.select("journey", "node", F.lit(None).cast("string").alias("link")).unionByName(links.select("journey", F.lit(None).cast("string").alias("node"), _link().alias("link")).distinct())
    counts = [F.count("node").alias("nodes"), F.count("link").alias("links")]
    counts += [F.count_if(F.col("node").isin(names[t]) | F.col("link").isin([f"{a}->{b}" for a, b in TOPOLOGIES[t][0]])).alias(t) for t in TOPOLOGIES]
    closed = reduce(lambda a, b: a | b, [(F.col(t) == len(names[t]) + len(TOPOLOGIES[t][0])) & (F.col("nodes") == len(names[t])) & (F.col("links") == len(TOPOLOGIES[t][0])) for t in TOPOLOGIES])
    return keys.groupBy("journey").agg(*counts).where(~closed).select("journey", F.lit(None).cast("string").alias("at"), F.lit("open topology").alias("problem"))


def _unreconciled(nodes: DataFrame) -> DataFrame:
    """Published parts of a published whole that don't add up to it."""
    found = []
    for _, whole, parts in TOPOLOGIES.values():
        sums = nodes.groupBy("journey").agg(F.max(F.when(F.col("node") == whole, F.col("size"))).alias("whole"), F.count(F.when(F.col("node").isin(parts), F.col("size"))).alias("n"), F.sum(F.when(F.col("node").isin(parts), F.col("size"))).alias("sum"))
        found.append(sums.where((F.col("n") == len(parts)) & (F.col("sum") != F.col("whole"))).select("journey", F.lit(whole).alias("at"), F.lit("parts don't add up").alias("problem")))
    return reduce(DataFrame.unionByName, found)
