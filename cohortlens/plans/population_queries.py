"""Named queries over populations, orders and contracts, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import contracts, populations
from cohortlens.plans.queries import K, query
from cohortlens.plans.views import POPULATION, population, table


@query("SELECT o_orderpriority AS track, count(*) AS applied, count(*) FILTER (lower(trim(o_orderstatus)) IN ('f', 'o')) AS accepted, count(*) FILTER (trim(CAST(o_custkey AS VARCHAR)) <> '') AS named FROM orders GROUP BY 1")
def funnel_stage(spark, d):
    stages = {"applied": populations.stage("any_row"), "accepted": populations.stage("value_in", F.col("o_orderstatus"), ["F", "O"]), "named": populations.stage("non_empty", F.col("o_custkey"))}
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("track")).agg(*[F.count_if(c).alias(k) for k, c in stages.items()])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'question_not_present' WHEN trim(coalesce(lang, '')) = '' THEN 'empty' ELSE 'answered' END AS state, CASE WHEN doc_id % 3 <> 0 AND trim(coalesce(lang, '')) <> '' THEN trim(lang) END AS value FROM documents")
def three_state_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", populations.answer(F.col("doc_id") % 3 != 0, F.col("lang")).alias("a")).select("doc_id", "a.*")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'kept' ELSE 'invalid_relation' END AS outcome FROM orders")
def population_filter(spark, d):
    people = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return populations.related(table(spark, d, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey").select("o_orderkey", "outcome")


@query("SELECT c_custkey AS subject, 'remaining' AS part FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def exclusion_plan(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    excluded = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject"))
    remaining, unknown = populations.exclusion(known, excluded, "subject")
    return remaining.withColumn("part", F.lit("remaining")).unionByName(unknown.withColumn("part", F.lit("unknown")))


@query("SELECT subject, CASE WHEN observed = 0 THEN 'missing' WHEN expected = 0 THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT subject, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed FROM (SELECT c_custkey AS subject, count(*) AS expected FROM customer GROUP BY 1) FULL JOIN (SELECT o_custkey AS subject, count(*) AS observed FROM orders GROUP BY 1) USING (subject)) WHERE observed <> 1 OR expected <> 1")
def population_equality(spark, d):
    return populations.compared(table(spark, d, "customer").select(F.col("c_custkey").alias("subject")), table(spark, d, "orders").select(F.col("o_custkey").alias("subject")), "subject")


@query("SELECT o_custkey AS subject, bool_or(o_orderstatus = 'F') AS checked, bool_or(o_orderstatus = 'O') AS team FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def people_sets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderstatus")
    return populations.membership({"checked": o.where("o_orderstatus = 'F'"), "team": o.where("o_orderstatus = 'O'")}, "subject")


@query("SELECT subject FROM (SELECT o_custkey AS subject, 1 AS s FROM orders UNION SELECT c_custkey, 2 FROM customer UNION SELECT user_id, 3 FROM events) GROUP BY subject HAVING count(*) < 3")
def surface_parity(spark, d):
    """Subjects that aren't on each surface."""
    sides = {"report": table(spark, d, "orders").select(F.col("o_custkey").alias("subject")), "people": table(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "events": table(spark, d, "events").select(F.col("user_id").alias("subject"))}
    return populations.membership(sides, "subject").where("not (report and people and events)").select("subject")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def distinct_inputs(spark, d):
    """Digests that two inputs share."""
    found = table(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return found.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT o_orderpriority AS source_type, CASE WHEN o_orderpriority = '1-URGENT' THEN count(*) ELSE count(DISTINCT o_custkey) END AS n FROM orders GROUP BY 1")
def source_row_counts(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source_type")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("payloads"))
    return rows.select("source_type", F.when(F.col("source_type") == "1-URGENT", F.col("rows")).otherwise(F.col("payloads")).alias("n"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def first_by_id(spark, d):
    return populations.first_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE year(o_orderdate) END DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 6")
def top_career_roles(spark, d):
    roles = table(spark, d, "orders").withColumn("start", F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")))
    return populations.top_roles(roles, "o_custkey", F.col("o_orderstatus") == "O", "start", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""WITH p AS (SELECT p_brand, p_partkey, p_partkey % 5 AS engagement, p_size % 4 AS recency FROM part),
 e AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY engagement DESC, recency DESC, p_partkey) AS i FROM p), l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY recency DESC, engagement DESC, p_partkey) AS i FROM p),
 turns AS (SELECT p_brand, p_partkey, 1 AS list, i FROM e WHERE i <= 2 UNION ALL SELECT p_brand, p_partkey, 2, i FROM l WHERE i <= 2 UNION ALL SELECT p_brand, p_partkey, 3, i FROM e UNION ALL SELECT p_brand, p_partkey, 4, i FROM l),
 once AS (SELECT p_brand, p_partkey, min({'l': list, 'i': i}) AS turn FROM turns GROUP BY ALL)
 SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn) AS rank FROM once) WHERE rank <= 3""")
def top_rich_projects(spark, d):
    """Engagement and recency with many ties."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 5).alias("engagement"), (F.col("p_size") % 4).alias("recency"))
    return populations.rich_projects(p, "p_brand", "engagement", "recency", "p_partkey").select("p_brand", "p_partkey", "rank")


@query(f"WITH {POPULATION} SELECT id, CASE WHEN present THEN 0 WHEN accepted THEN 1 ELSE 2 END AS priority FROM pop")
def processing_priority(spark, d):
    return population(spark, d).select("id", populations.processing_priority(F.col("present"), F.col("accepted")).alias("priority"))


@query("SELECT c_custkey, printf('candidate-%04d', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) AS ordinal FROM customer")
def review_ordinals(spark, d):
    return table(spark, d, "customer").select("c_custkey", populations.review_ordinal(["c_nationkey"], F.desc("c_acctbal"), "c_custkey").alias("ordinal"))


# --- contracts

@query("""WITH s AS (SELECT c_nationkey AS nation, stage, n FROM (SELECT c_nationkey, count(*) AS a, count(*) FILTER (c_acctbal > 0) AS b, count(*) FILTER (c_acctbal > 500) AS c FROM customer GROUP BY 1) UNPIVOT (n FOR stage IN (a, b, c)))
 SELECT nation, place, n, drop FROM (SELECT nation, stage AS place, n, lag(n) OVER (PARTITION BY nation ORDER BY stage) - n AS drop FROM s) WHERE drop < 0 OR drop BETWEEN 1 AND 4""")
def funnel_drops(spark, d):
    stages = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("c_acctbal") > 0).alias("b"), F.count_if(F.col("c_acctbal") > 500).alias("c"))
    return contracts.funnel_violations(stages.unpivot("nation", ["a", "b", "c"], "place", "n"), K, ["nation"]).select("nation", "place", "n", "drop")


_CELLS = "c AS (SELECT c_nationkey AS nation, c_mktsegment AS item, count(*) AS n FROM customer GROUP BY ALL), v AS (SELECT *, CASE WHEN n % 5 > 0 THEN n END AS value, sum(n) OVER (PARTITION BY nation) AS total FROM c)"


def _items(spark, d):
    """Counts by nation and item of which some are withheld, and the nation's total."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy("nation").agg(F.sum("n").alias("total"))
    return n.withColumn("value", F.when(F.col("n") % 5 > 0, F.col("n"))).join(totals, "nation")


@query(f"""WITH {_CELLS}, s AS (SELECT nation, count(*) FILTER (value IS NULL) AS w, coalesce(sum(value), 0) AS k, max(total) AS t FROM v GROUP BY 1)
 SELECT nation, problem FROM (SELECT nation, CASE WHEN w = 1 THEN 'single_withheld' WHEN w = 0 AND t <> k THEN 'sum' WHEN w > 0 AND (t - k < 0 OR t - k BETWEEN 1 AND 4) THEN 'remainder' END AS problem FROM s) WHERE problem IS NOT NULL""")
def selection_outcomes(spark, d):
    return contracts.selection_violations(_items(spark, d), ["nation"], "total", K)


@query(f"""WITH {_CELLS}, k AS (SELECT *, CASE WHEN nation % 11 = 10 THEN NULL WHEN nation % 13 = 12 THEN total + 1 ELSE total - nation % 3 END AS known, CASE nation % 4 WHEN 3 THEN 'overlapping' ELSE 'exclusive' END AS mode FROM v),
 s AS (SELECT nation, any_value(known) AS known, any_value(total) AS total, any_value(mode) AS mode, list(value) AS vs FROM k GROUP BY 1),
 p AS (SELECT nation, CASE WHEN known IS NULL OR known > total THEN 'known' WHEN len(list_filter(vs, lambda x: x > known)) > 0 THEN 'item' WHEN mode = 'overlapping' THEN NULL
  WHEN list_count(vs) = len(vs) AND list_sum(vs) <> known THEN 'sum' WHEN coalesce(list_sum(vs), 0) > known THEN 'sum' WHEN len(vs) - list_count(vs) = 1 THEN 'single_withheld' END AS problem FROM s) SELECT nation, problem FROM p WHERE problem IS NOT NULL""")
def dimension_contract(spark, d):
    """Some nations withhold what is known, or say that more is known than there is; some dimensions overlap."""
    nation, total = F.col("nation"), F.col("total")
    known = F.when(nation % 11 == 10, None).when(nation % 13 == 12, total + 1).otherwise(total - nation % 3)
    items = _items(spark, d).withColumns({"known": known, "mode": F.when(nation % 4 == 3, "overlapping").otherwise("exclusive")})
    return contracts.dimension_violations(items, ["nation"], "known", "total", "mode", "item")


@query(f"""WITH {_CELLS}, i AS (SELECT nation || '/' || item AS component, value FROM v), x AS (SELECT s_suppkey AS key, s_suppkey % 12 AS value, [(s_nationkey || '/BUILDING'), CASE WHEN s_suppkey % 9 = 0 THEN s_nationkey || '/NONE' ELSE s_nationkey || '/MACHINERY' END] || CASE WHEN s_suppkey % 10 = 0 THEN [s_nationkey || '/BUILDING'] ELSE [] END AS components FROM supplier),
 p AS (SELECT key, x.value, unnest(components) AS component FROM x), j AS (SELECT p.*, i.component IS NOT NULL AS there, i.value AS part FROM p LEFT JOIN i ON i.component = p.component),
 s AS (SELECT key, max(value) AS value, count(DISTINCT component) AS n, count(component) AS every, count(*) FILTER (NOT there) AS u, count(*) FILTER (there AND part IS NULL) AS w, min(part) AS least FROM j GROUP BY 1)
 SELECT key, problem FROM (SELECT key, CASE WHEN every > n THEN 'repeated' WHEN n < 2 THEN 'components' WHEN u > 0 THEN 'unknown' WHEN value IS NOT NULL AND w > 0 THEN 'over_withheld' WHEN value > least THEN 'count' END AS problem FROM s) WHERE problem IS NOT NULL""")
def intersection_contract(spark, d):
    items = _items(spark, d).select(F.concat_ws("/", F.col("nation").cast("string"), "item").alias("component"), "value")
    nation = F.col("s_nationkey").cast("string")
    first = F.concat(nation, F.lit("/BUILDING"))
    second = F.when(F.col("s_suppkey") % 9 == 0, F.concat(nation, F.lit("/NONE"))).otherwise(F.concat(nation, F.lit("/MACHINERY")))
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 12).alias("value"), F.concat(F.array(first, second), F.when(F.col("s_suppkey") % 10 == 0, F.array(first)).otherwise(F.array().cast("array<string>"))).alias("components"))
    return contracts.intersection_violations(pairs, items, "key")


@query("""WITH a AS (SELECT o_custkey AS owner, count(*) AS eligible, count(*) FILTER (o_orderstatus <> 'P') AS present, max(o_orderstatus) <> 'P' AS complete FROM orders GROUP BY 1)
 SELECT owner, problem FROM (SELECT owner, CASE WHEN eligible < present THEN 'present' WHEN eligible - present BETWEEN 1 AND 4 THEN 'complement' WHEN complete <> (eligible = present) THEN 'status' END AS problem FROM a) WHERE problem IS NOT NULL""")
def artifact_contract(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("o_orderstatus") != "P").alias("present"), (F.max("o_orderstatus") != "P").alias("complete"))
    return contracts.artifact_violations(a, K).select("owner", "problem")


_JOURNEY = """n AS (SELECT c_nationkey AS nation, count(*) AS all_, count(*) FILTER (c_acctbal > 0) AS went, count(*) FILTER (c_acctbal > 500) AS came FROM customer GROUP BY 1),
 nodes AS (SELECT nation || ':a' AS node, 1 AS place, CASE WHEN nation % 9 > 0 THEN all_ END AS size FROM n UNION ALL SELECT nation || ':b', 2, went FROM n UNION ALL SELECT nation || ':c', 2, CASE WHEN nation % 5 > 0 THEN all_ - went END FROM n UNION ALL SELECT nation || ':d', CASE WHEN nation % 7 = 0 THEN 2 ELSE 3 END, came FROM n),
 links AS (SELECT nation || ':a' AS source, nation || ':b' AS target, CASE WHEN nation % 4 > 0 THEN went + nation % 3 - 1 END AS n FROM n UNION ALL SELECT nation || ':a', nation || ':c', CASE WHEN nation % 5 > 0 THEN all_ - went END FROM n
  UNION ALL SELECT nation || ':b', nation || ':d', came FROM n UNION ALL SELECT nation || ':d', nation || CASE WHEN nation % 2 = 0 THEN ':d' ELSE ':e' END, 1 FROM n WHERE nation % 6 < 2 UNION ALL SELECT nation || ':b', nation || ':d', came FROM n WHERE nation % 8 = 1)"""


@query(f"""WITH {_JOURNEY}, l AS (SELECT l.*, s.node AS s, t.node AS t, s.place AS sp, t.place AS tp, s.size AS ss, t.size AS ts FROM links l LEFT JOIN nodes s ON s.node = source LEFT JOIN nodes t ON t.node = target),
 a AS (SELECT DISTINCT source, target, CASE WHEN s IS NULL OR t IS NULL THEN 'unknown_node' WHEN source = target THEN 'self' WHEN sp >= tp THEN 'backward' WHEN n > ss OR n > ts THEN 'endpoint' WHEN n IS NOT NULL AND ss - ts BETWEEN 1 AND 4 THEN 'nested_remainder'
  WHEN (SELECT count(*) FROM links m WHERE m.source = l.source AND m.target = l.target) > 1 THEN 'repeated' END AS problem FROM l),
 b AS (SELECT node, size, (SELECT count(*) FROM links WHERE source = node) AS k, (SELECT count(*) FROM links WHERE source = node AND n IS NULL) AS w, (SELECT coalesce(sum(n), 0) FROM links WHERE source = node) AS o, (SELECT coalesce(sum(n), 0) FROM links WHERE target = node) AS i FROM nodes WHERE size IS NOT NULL),
 c AS (SELECT node, CASE WHEN k >= 2 AND w = 1 THEN 'single_withheld' WHEN w > 0 AND size - o BETWEEN 1 AND 4 THEN 'withheld_remainder' WHEN o > size THEN 'outgoing' WHEN i > size THEN 'incoming' END AS problem FROM b)
 SELECT source, target, NULL AS node, problem FROM a WHERE problem IS NOT NULL UNION ALL SELECT NULL, NULL, node, problem FROM c WHERE problem IS NOT NULL""")
def journey_contract(spark, d):
    """Each nation's journey, most of them with something wrong."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("c_acctbal") > 0).alias("went"), F.count_if(F.col("c_acctbal") > 500).alias("came"))
    k, missed = F.col("nation"), F.when(F.col("nation") % 5 > 0, F.col("all") - F.col("went"))
    at = lambda stage: F.concat(k.cast("string"), F.lit(":"), stage if not isinstance(stage, str) else F.lit(stage))
    node = lambda stage, place, size: F.struct(at(stage).alias("node"), place.alias("place"), size.alias("size"))
    link = lambda a, b, size, when=F.lit(True): F.when(when, F.struct(at(a).alias("source"), at(b).alias("target"), size.cast("long").alias("n")))
    nodes = F.array(node("a", F.lit(1), F.when(k % 9 > 0, F.col("all"))), node("b", F.lit(2), F.col("went")), node("c", F.lit(2), missed), node("d", F.when(k % 7 == 0, 2).otherwise(3), F.col("came")))
    links = F.array_compact(F.array(
        link("a", "b", F.when(k % 4 > 0, F.col("went") + k % 3 - 1)), link("a", "c", missed), link("b", "d", F.col("came")), link("d", F.when(k % 2 == 0, "d").otherwise("e"), F.lit(1), k % 6 < 2), link("b", "d", F.col("came"), k % 8 == 1),
    ))
    return contracts.journey_violations(n.select(F.explode(links).alias("l")).select("l.*"), n.select(F.explode(nodes).alias("n")).select("n.*"), K)
