"""The engine's concepts derived from the star schema, once, for the queries and mirrored by the SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it has fewer splits than these, for work that costs more than moving its rows; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def population(spark: SparkSession, d: str) -> DataFrame:
    """Applicants; accepted and present are true or unknown."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    came = o.groupBy(F.col("o_custkey").alias("id")).agg(F.lit(True).alias("accepted"), F.when(F.max("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"), True).alias("present"))
    c = table(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.lower(F.concat("c_name", F.lit("@example.test"))).alias("email"), F.col("c_mktsegment").alias("track"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return people.join(came, "id", "left")


POPULATION = """pop AS (SELECT c_custkey AS id, lower(c_name || '@example.test') AS email, c_mktsegment AS track, c_nationkey AS nation, c_acctbal AS balance, accepted, present
 FROM customer LEFT JOIN (SELECT o_custkey, TRUE AS accepted, CASE WHEN max(o_orderdate) >= TIMESTAMP '1997-01-01' THEN TRUE END AS present FROM orders
 WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) a ON o_custkey = c_custkey)"""


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """Who takes part in which team and project, and whether it was submitted."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("submitted"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return li.join(o, "l_orderkey").select("id", F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("project"), "submitted")


MEMBERSHIPS = "mem AS (SELECT o_custkey AS id, l_suppkey AS team, l_partkey AS project, l_returnflag = 'R' AS submitted FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"

# The tiers of each dimension.
DIMENSIONS = {
    "technical_depth": ["basic", "moderate", "advanced", "exceptional"], "originality": ["derivative", "differentiated", "ambitious"], "external_validation": ["none_observed", "early_signal", "meaningful", "strong"],
    "execution_scope": ["contributor", "substantial_contributor", "primary_builder", "end_to_end_builder"], "builder_level": ["exploratory", "substantial", "standout"], "product_maturity": ["concept", "prototype", "working_product", "production_evidence"],
}
_STRIDE = {d: 3 + 4 * i for i, d in enumerate(DIMENSIONS)}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Population facts: a state for each applicant, and tiers that follow from the key."""
    p = population(spark, d)
    m = F.col("id") % 20
    state = F.when(m == 0, "rejected").when(m == 1, "no_evidence").when(m == 2, "provider_unavailable").when(m == 3, "conflict").when(m == 4, "excluded").otherwise("assessed")
    tier = lambda name: F.element_at(F.array(*map(F.lit, DIMENSIONS[name])), (F.floor(F.col("id") / _STRIDE[name]) % len(DIMENSIONS[name]) + 1).cast("int"))
    return p.select("*", state.alias("assessment_state"), *[tier(n).alias(n) for n in DIMENSIONS])


FACTS = POPULATION + """, facts AS (SELECT *, CASE id % 20 WHEN 0 THEN 'rejected' WHEN 1 THEN 'no_evidence' WHEN 2 THEN 'provider_unavailable' WHEN 3 THEN 'conflict' WHEN 4 THEN 'excluded' ELSE 'assessed' END AS assessment_state, """ + ", ".join(
    f"[{', '.join(repr(v) for v in values)}][CAST(id // {_STRIDE[n]} % {len(values)} + 1 AS INT)] AS {n}" for n, values in DIMENSIONS.items()
) + " FROM pop)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Three yes-or-no signals for each applicant."""
    marks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("founder_evidence"),
        F.bool_or((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH")).alias("technical_function"), F.bool_or(F.col("o_totalprice") > 400000).alias("shipped_product_evidence"),
    )
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return people.join(marks, "id", "left").select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("founder_evidence", "technical_function", "shipped_product_evidence")])


SIGNALS = """sig AS (SELECT c_custkey AS id, coalesce(f, FALSE) AS f, coalesce(t, FALSE) AS t, coalesce(s, FALSE) AS s FROM customer LEFT JOIN (SELECT o_custkey,
 bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS f, bool_or(o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AS t, bool_or(o_totalprice > 400000) AS s FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """By track and nation how many applicants have a high balance: small counts and zeros among larger ones."""
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("track"), F.col("c_nationkey").alias("cell")).agg(F.count_if(F.col("c_acctbal") > 7000).alias("n"), F.count(F.lit(1)).alias("total"))


CELLS = "cells AS (SELECT c_mktsegment AS track, c_nationkey AS cell, count(*) FILTER (c_acctbal > 7000) AS n, count(*) AS total FROM customer GROUP BY ALL)"
