"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators import aggregate, contracts, identity, lifecycle, matching, predicates, scoring, suppress
from cohortlens.plans import views
from cohortlens.plans.views import CELLS, FACTS, MEMBERSHIPS, POPULATION, SIGNALS, table
from cohortlens.streaming import interactions

K = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A word boundary that knows letters of every script, for the SQL side.
B, E = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _has(column: str, pattern: str) -> str:
    return "regexp_matches({}, '{}(?:{}){}')".format(column, B, pattern.replace("'", "''"), E)


# --- funnels, populations, metrics


@query(f"WITH {POPULATION}, {MEMBERSHIPS} SELECT stage, n FROM (SELECT count(*) AS applied, count(accepted) AS accepted, count(present) AS present, (SELECT count(DISTINCT id) FROM mem WHERE submitted) AS submitted FROM pop) UNPIVOT (n FOR stage IN (applied, accepted, present, submitted))")
def funnel_counts(spark, d):
    submitted = views.memberships(spark, d).where("submitted").select("id").distinct().withColumn("submitted", F.lit(True))
    people = views.population(spark, d).join(submitted, "id", "left")
    stages = {"applied": F.lit(True)} | {s: F.coalesce(s, F.lit(False)) for s in ("accepted", "present", "submitted")}
    return aggregate.counted(people, stages, []).withColumnRenamed("cell", "stage")


@query("""WITH log AS (SELECT o_orderkey AS id, o_custkey AS person, o_orderpriority <> '5-LOW' AS granted, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sup FROM orders)
 SELECT c_custkey AS person_id, c_nationkey AS nation FROM customer WHERE c_acctbal >= -500 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
 AND NOT EXISTS (SELECT 1 FROM log l WHERE l.person = c_custkey AND NOT l.granted AND NOT EXISTS (SELECT 1 FROM log m WHERE m.sup = l.id))""")
def eligible_population(spark, d):
    o = table(spark, d, "orders")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") < -500, "ghost").otherwise("active").alias("state"))
    reviews = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("person_id"), F.lit("open").alias("status"))
    log = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), (F.col("o_orderpriority") != "5-LOW").alias("granted"))
    return lifecycle.eligible(people, reviews, matching.current(matching.superseding(log, ["person_id"], "id"), "id")).select("person_id", "nation")


_METRIC_SQL = {
    "advanced_technical_evidence": "technical_depth IN ('advanced', 'exceptional')", "differentiated_problem": "originality IN ('ambitious', 'differentiated')",
    "meaningful_validation": "external_validation IN ('meaningful', 'strong')", "primary_execution": "execution_scope IN ('end_to_end_builder', 'primary_builder')",
    "serious_product_builder": "builder_level IN ('standout', 'substantial') AND product_maturity IN ('production_evidence', 'working_product')",
    "standout_builder": "builder_level = 'standout'", "substantive_technical_evidence": "technical_depth IN ('advanced', 'exceptional', 'moderate')",
}
_COHORTS = "coh AS (SELECT unnest(list_filter(['all', CASE WHEN accepted THEN 'accepted' END, CASE WHEN present THEN 'attended' END], lambda x: x IS NOT NULL)) AS cohort, * FROM facts)"


def _metric_cells(where: str = "") -> str:
    parts = [f"SELECT cohort, nation, '{k}' AS cell, count(*) FILTER (assessment_state = 'assessed' AND {c}) AS n, count(*) FILTER (assessment_state <> 'excluded') AS eligible FROM coh GROUP BY ALL" for k, c in _METRIC_SQL.items()]
    return f"WITH {FACTS}, {_COHORTS}, m AS ({' UNION ALL '.join(parts)})"


@query(_metric_cells() + """, p9 AS (SELECT *, (n > 0 AND n < 5) OR (eligible - n > 0 AND eligible - n < 5) AS bad9 FROM m),
 p11 AS (SELECT a.*, bad9 OR coalesce(a.n - b.n BETWEEN 1 AND 4, FALSE) AS bad11 FROM p9 a LEFT JOIN m b ON a.cell = 'substantive_technical_evidence' AND b.cell = 'advanced_technical_evidence' AND a.cohort = b.cohort AND a.nation = b.nation),
 r AS (SELECT *, CASE cohort WHEN 'all' THEN 0 WHEN 'accepted' THEN 1 ELSE 2 END AS rank FROM p11),
 q AS (SELECT *, coalesce(max(n) FILTER (rank = 0) OVER w, 0) AS n0, coalesce(max(n) FILTER (rank = 1) OVER w, 0) AS n1, coalesce(max(n) FILTER (rank = 2) OVER w, 0) AS n2 FROM r WINDOW w AS (PARTITION BY nation, cell)),
 p14 AS (SELECT *, bad11 OR (rank < 2 AND n0 - n1 BETWEEN 1 AND 4) OR (rank > 0 AND n1 - n2 BETWEEN 1 AND 4) AS bad FROM q)
 SELECT cohort, nation, cell AS metric, CASE WHEN NOT bad THEN n END AS value, CASE WHEN bad THEN 'withheld' ELSE 'published' END AS privacy FROM p14""")
def cohort_metrics(spark, d):
    """The flagship: registered metrics over nested cohorts, suppressed point by point, by subsets and across cohorts."""
    facts = aggregate.in_cohorts(views.facts(spark, d))
    wide = facts.groupBy("cohort", "nation").agg(
        *[F.count_if(aggregate.assessed() & predicates.compiled(p)).alias(k) for k, p in predicates.METRICS.items()], F.count_if(F.col("assessment_state") != "excluded").alias("eligible")
    )
    cells = aggregate.unpivoted(wide, list(predicates.METRICS), ["cohort", "nation", "eligible"])
    relations = spark.createDataFrame(predicates.METRIC_RELATIONS, "broader string, narrower string")
    safe = suppress.p11_subsets(suppress.p9_complement(cells, "eligible", K), relations, ["cohort", "nation"], K)
    return suppress.p14_cross_cohort(safe, predicates.COHORTS, ["nation"], K).select("cohort", "nation", F.col("cell").alias("metric"), "value", "privacy")


@query(f"WITH {FACTS}, {_COHORTS} SELECT cohort, state, n FROM (SELECT cohort, " + ", ".join(f"count(*) FILTER (assessment_state = '{s}') AS {s}" for s in predicates.STATES)
       + ", count(*) AS total, count(*) FILTER (assessment_state <> 'excluded') AS eligible, count(*) FILTER (assessment_state NOT IN ('excluded', 'assessed')) AS unknown FROM coh GROUP BY cohort) UNPIVOT (n FOR state IN (" + ", ".join([*predicates.STATES, "total", "eligible", "unknown"]) + "))")
def state_counts(spark, d):
    return aggregate.state_counts(aggregate.in_cohorts(views.facts(spark, d)), ["cohort"]).withColumnRenamed("cell", "state")


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, CASE WHEN assessment_state = 'assessed' THEN {n} ELSE 'unknown' END AS cell, count(*) AS n FROM facts WHERE assessment_state <> 'excluded' GROUP BY ALL" for n in views.DIMENSIONS))
def taxonomy_exclusive(spark, d):
    return aggregate.exclusive_counts(views.facts(spark, d), list(views.DIMENSIONS))


@query("""WITH e AS (SELECT user_id, list_distinct(list(event_type)) AS labels FROM events WHERE value > 50 GROUP BY user_id),
 p AS (SELECT c_custkey, labels FROM customer LEFT JOIN e ON user_id = c_custkey)
 SELECT cell, count(*) AS n FROM (SELECT unnest(CASE WHEN labels IS NULL THEN ['unknown'] ELSE labels END) AS cell FROM p) GROUP BY cell""")
def taxonomy_overlapping(spark, d):
    e = table(spark, d, "events").where("value > 50").groupBy(F.col("user_id").alias("c_custkey")).agg(F.collect_set("event_type").alias("labels"))
    return aggregate.overlapping_counts(table(spark, d, "customer").select("c_custkey").join(e, "c_custkey", "left"), "labels")


@query(f"WITH {FACTS}, {_COHORTS}, g AS (SELECT *, originality AS problem_differentiation FROM coh) " + " UNION ALL ".join(f"SELECT cohort, '{k}' AS cell, count(*) FILTER (assessment_state = 'assessed' AND {dim} IN ({', '.join(repr(x) for x in v)})) AS n FROM g GROUP BY cohort" for k, (dim, v) in predicates.GROUPS.items()))
def public_groups(spark, d):
    facts = views.facts(spark, d).withColumn("problem_differentiation", F.col("originality"))
    return aggregate.group_counts(aggregate.in_cohorts(facts), ["cohort"])


@query(f"WITH {FACTS} SELECT id, list_filter([" + ", ".join(f"CASE WHEN assessment_state = 'assessed' AND {c} THEN '{k}' END" for k, c in sorted(_METRIC_SQL.items())) + "], lambda x: x IS NOT NULL)::VARCHAR AS keys FROM facts")
def row_metric_keys(spark, d):
    keys = aggregate.metric_keys()
    return views.facts(spark, d).select("id", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"))


_REGIONS = " UNION ALL ".join(f"SELECT '{k}' AS cell, count(*) FILTER (f = {a} AND t = {b} AND s = {c}) AS n FROM sig" for k, (a, b, c) in predicates.REGIONS.items())


def _p15(k: int) -> str:
    return f"WITH {SIGNALS}, r AS ({_REGIONS}) SELECT cell, n, CASE WHEN bad THEN 'withheld' ELSE 'published' END AS privacy, CASE WHEN NOT bad THEN n END AS value FROM (SELECT *, bool_or(n > 0 AND n < {k}) OVER () AS bad FROM r)"


@query(f"WITH {SIGNALS} {_REGIONS}")
def exact_regions(spark, d):
    return aggregate.exact_regions(views.signals(spark, d))


@query(f"WITH {SIGNALS} SELECT 'founder_evidence' AS signal, count(*) FILTER (f) AS n, count(*) FILTER (NOT f) AS complement FROM sig UNION ALL SELECT 'technical_function', count(*) FILTER (t), count(*) FILTER (NOT t) FROM sig UNION ALL SELECT 'shipped_product_evidence', count(*) FILTER (s), count(*) FILTER (NOT s) FROM sig")
def region_marginals(spark, d):
    return aggregate.region_marginals(aggregate.exact_regions(views.signals(spark, d)))


@query(_p15(5))
def suppress_p15(spark, d):
    return suppress.p15_partition(aggregate.exact_regions(views.signals(spark, d)), 5)


@query(_p15(50))
def suppress_p15_wide(spark, d):
    return suppress.p15_partition(aggregate.exact_regions(views.signals(spark, d)), 50)


@query(f"WITH {MEMBERSHIPS}, t AS (SELECT s_suppkey, s_nationkey AS track, coalesce(bool_or(submitted), FALSE) AS submitted FROM supplier LEFT JOIN mem ON team = s_suppkey GROUP BY ALL) SELECT track, count(*) FILTER (submitted) AS submitted, count(*) FILTER (NOT submitted) AS not_submitted FROM t GROUP BY track")
def track_submission_matrix(spark, d):
    done = views.memberships(spark, d).groupBy(F.col("team").alias("s_suppkey")).agg(F.bool_or("submitted").alias("done"))
    teams = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("track")).join(done, "s_suppkey", "left")
    return aggregate.matrix(teams, "track", "done")


@query("SELECT c_mktsegment AS track, p_brand AS domain, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def track_domain_heatmap(spark, d):
    m = views.memberships(spark, d)
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("project"), F.col("p_brand").alias("domain"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("track"))
    once = m.join(brand, "project").select("id", "domain").distinct()  # a person counts once, and the join after it is small
    return once.join(people, "id").groupBy("track", "domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEMBERSHIPS}, s AS (SELECT id, count(DISTINCT team) AS teams FROM mem GROUP BY id) SELECT CASE WHEN teams IS NULL THEN 'none' WHEN teams = 1 THEN 'solo' WHEN teams <= 10 THEN 'few' ELSE 'many' END AS composition, count(*) AS n FROM customer LEFT JOIN s ON id = c_custkey GROUP BY 1")
def composition(spark, d):
    teams = views.memberships(spark, d).select("id", "team").distinct().groupBy(F.col("id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("teams"))
    kind = F.when(F.col("teams").isNull(), "none").when(F.col("teams") == 1, "solo").when(F.col("teams") <= 10, "few").otherwise("many")
    return table(spark, d, "customer").select("c_custkey").join(teams, "c_custkey", "left").groupBy(kind.alias("composition")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT artifact, present, eligible, CASE WHEN present = eligible THEN 'complete' WHEN present = 0 THEN 'missing' ELSE 'partial' END AS status FROM (SELECT count(*) AS eligible, count(*) FILTER (p_size > 25) AS repository, count(*) FILTER (p_retailprice > 1000) AS demo, count(*) FILTER (p_name IS NOT NULL) AS title FROM part) UNPIVOT (present FOR artifact IN (repository, demo, title))")
def artifact_completeness(spark, d):
    wide = table(spark, d, "part").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("p_size") > 25).alias("repository"), F.count_if(F.col("p_retailprice") > 1000).alias("demo"), F.count("p_name").alias("title"))
    found = aggregate.unpivoted(wide, ["repository", "demo", "title"], ["eligible"], "artifact", "present")
    return found.withColumn("status", F.when(F.col("present") == F.col("eligible"), "complete").when(F.col("present") == 0, "missing").otherwise("partial"))


# --- suppression over a table of small and larger cells


def _rule(bad: str, extra: str = "", source: str = "cells", columns: str = "track, cell, n") -> str:
    return f"WITH {CELLS}{extra} SELECT {columns}, CASE WHEN bad THEN 'withheld' ELSE 'published' END AS privacy, CASE WHEN NOT bad THEN n END AS value FROM (SELECT *, {bad} AS bad FROM {source})"


def _comp(primary: str, candidate: str) -> str:
    return f"""WITH {CELLS}, m AS (SELECT *, {primary} AS p, {candidate} AS c FROM cells), w AS (SELECT *, count(*) FILTER (p) OVER (PARTITION BY track) AS np, row_number() OVER (PARTITION BY track ORDER BY c DESC, n, cell) AS r FROM m),
 s AS (SELECT *, CASE WHEN p THEN 'primary' WHEN np = 1 AND c AND r = 1 THEN 'complementary' ELSE 'published' END AS privacy FROM w) SELECT track, cell, n, privacy, CASE WHEN privacy = 'published' THEN n END AS value FROM s"""


def _cells(spark, d):
    return views.cells(spark, d).select("track", "cell", "n")


@query(_comp("n < 5", "n >= 5"))
def suppress_p1(spark, d):
    return suppress.p1_distribution(_cells(spark, d), ["track"], K)


@query(_rule("bool_or(n < 2) OVER (PARTITION BY track)"))
def suppress_p2(spark, d):
    return suppress.p2_crosstab(_cells(spark, d), ["track"], 2)


@query(_rule("n > 0 AND n < 5"))
def suppress_p3(spark, d):
    return suppress.p3_point(_cells(spark, d), K)


@query(_rule("(n > 0 AND n < 5) OR (total - n > 0 AND total - n < 5)", columns="track, cell, n, total"))
def suppress_p4(spark, d):
    return suppress.p4_nested(views.cells(spark, d), "total", K)


@query(f"WITH {CELLS} SELECT track, cell, n, total FROM cells WHERE (n > 0 AND n < 5) OR (total - n > 0 AND total - n < 5)")
def suppress_p5(spark, d):
    return suppress.p5_binary_violations(views.cells(spark, d), "total", K)


@query(_comp("n > 0 AND n < 5", "n >= 5"))
def suppress_p6(spark, d):
    return suppress.p6_exclusive(_cells(spark, d), ["track"], K)


@query(_rule("bool_or(n > 0 AND n < 2) OVER (PARTITION BY track)"))
def suppress_p7(spark, d):
    return suppress.p7_protected(_cells(spark, d), ["track"], 2)


@query(_rule("n < 2 OR bool_or(n > 0 AND n < 2) OVER (PARTITION BY track)"))
def suppress_p8(spark, d):
    return suppress.p8_reviewed(_cells(spark, d), ["track"], 2)


@query(_rule("(n > 0 AND n < 5) OR (total - n > 0 AND total - n < 5)", columns="track, cell, n, total"))
def suppress_p9(spark, d):
    return suppress.p9_complement(views.cells(spark, d), "total", K)


@query(_rule("bool_or((n > 0 AND n < 2) OR (total - n > 0 AND total - n < 2)) OVER (PARTITION BY track) OR (total - sum(n) OVER (PARTITION BY track) > 0 AND total - sum(n) OVER (PARTITION BY track) < 2)", columns="track, cell, n, total"))
def suppress_p10(spark, d):
    return suppress.p10_closure(views.cells(spark, d), ["track"], "total", 2)


_GROUP_COUNTS = ", ".join(f"count(*) FILTER (assessment_state = 'assessed' AND {dim} IN ({', '.join(map(repr, v))})) AS {k}" for k, (dim, v) in predicates.GROUPS.items())


@query(f"""WITH {FACTS}, {_COHORTS}, f AS (SELECT *, originality AS problem_differentiation FROM coh), w AS (SELECT cohort, nation, {_GROUP_COUNTS} FROM f GROUP BY cohort, nation), g AS (FROM w UNPIVOT (n FOR cell IN ({', '.join(predicates.GROUPS)}))),
 rel(broader, narrower) AS (VALUES {', '.join(map(str, predicates.GROUP_RELATIONS))}), bad AS (SELECT DISTINCT a.cohort, a.nation, a.cell FROM g a JOIN rel ON broader = a.cell JOIN g b ON b.cell = narrower AND b.cohort = a.cohort AND b.nation = a.nation WHERE a.n - b.n BETWEEN 1 AND 4)
 SELECT g.cohort, g.nation, g.cell, g.n, CASE WHEN bad.cell IS NULL THEN 'published' ELSE 'withheld' END AS privacy, CASE WHEN bad.cell IS NULL THEN g.n END AS value FROM g LEFT JOIN bad USING (cohort, nation, cell)""")
def suppress_p11(spark, d):
    facts = views.facts(spark, d).withColumn("problem_differentiation", F.col("originality"))
    cells = aggregate.group_counts(aggregate.in_cohorts(facts), ["cohort", "nation"])
    relations = spark.createDataFrame(predicates.GROUP_RELATIONS, "broader string, narrower string")
    return suppress.p11_subsets(cells, relations, ["cohort", "nation"], K).select("cohort", "nation", "cell", "n", "privacy", "value")


@query(_rule("total - n > 0 AND total - n < 5", columns="track, cell, n, total"))
def suppress_p12(spark, d):
    return suppress.p12_reviewed_complement(views.cells(spark, d), "total", K)


@query(f"""WITH {CELLS}, e AS (SELECT *, total - cell % 3 AS eligible FROM cells), u AS (SELECT *, (eligible > 0 AND eligible < 5) OR (total - eligible > 0 AND total - eligible < 5) AS hide FROM e),
 j AS (SELECT *, CASE WHEN hide THEN total ELSE eligible END AS den FROM u), b AS (SELECT *, (n > 0 AND n < 5) OR (den - n > 0 AND den - n < 5) AS bad FROM j)
 SELECT track, cell, n, total, eligible, CASE WHEN bad THEN 'withheld' ELSE 'published' END AS privacy, CASE WHEN NOT bad THEN n END AS value, CASE WHEN NOT hide THEN eligible END AS denominator FROM b""")
def suppress_p13(spark, d):
    return suppress.p13_denominator(views.cells(spark, d).withColumn("eligible", F.col("total") - F.col("cell") % 3), "eligible", "total", K)


@query(f"""WITH {FACTS}, {_COHORTS}, c AS (SELECT cohort, track, nation AS cell, count(*) AS n FROM coh GROUP BY ALL), r AS (SELECT *, CASE cohort WHEN 'all' THEN 0 WHEN 'accepted' THEN 1 ELSE 2 END AS rank FROM c),
 q AS (SELECT *, coalesce(max(n) FILTER (rank = 0) OVER w, 0) AS n0, coalesce(max(n) FILTER (rank = 1) OVER w, 0) AS n1, coalesce(max(n) FILTER (rank = 2) OVER w, 0) AS n2 FROM r WINDOW w AS (PARTITION BY track, cell)),
 b AS (SELECT *, (rank < 2 AND n0 - n1 BETWEEN 1 AND 4) OR (rank > 0 AND n1 - n2 BETWEEN 1 AND 4) AS bad FROM q)
 SELECT cohort, track, cell, n, CASE WHEN bad THEN 'withheld' ELSE 'published' END AS privacy, CASE WHEN NOT bad THEN n END AS value FROM b""")
def suppress_p14(spark, d):
    cells = aggregate.in_cohorts(views.facts(spark, d)).groupBy("cohort", "track", F.col("nation").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return suppress.p14_cross_cohort(cells, predicates.COHORTS, ["track"], K)


@query("SELECT c_nationkey AS nation, CASE WHEN c_nationkey % 2 = 0 OR count(*) < 50 THEN 10 ELSE 5 END AS k FROM customer GROUP BY c_nationkey")
def effective_k(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).select("nation", suppress.effective_k(F.col("n"), F.col("nation") % 2 == 0).alias("k"))


# --- contracts


@query(f"WITH {CELLS} SELECT track, cell, n, 'published' AS privacy, n AS value FROM cells WHERE n > 0 AND n < 5")
def contract_violations(spark, d):
    raw = _cells(spark, d).withColumns({"privacy": F.lit("published"), "value": F.col("n")})
    return contracts.count_violations(raw, K).unionByName(contracts.count_violations(suppress.p3_point(_cells(spark, d), K), K))


@query("""WITH links AS (SELECT o_orderstatus AS source, o_orderpriority AS target, count(*) AS n FROM orders GROUP BY ALL), nodes AS (SELECT o_orderstatus AS node, count(*) AS size FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) // 2 FROM orders GROUP BY 1),
 f AS (SELECT source AS node, CAST(sum(n) AS BIGINT) AS flow, 'out' AS side FROM links GROUP BY 1 UNION ALL SELECT target, CAST(sum(n) AS BIGINT), 'in' FROM links GROUP BY 1) SELECT node, flow, side, size FROM f LEFT JOIN nodes USING (node) WHERE size IS NULL OR flow > size""")
def flow_conservation(spark, d):
    o = table(spark, d, "orders")
    links = o.groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n")
    nodes = links.groupBy(F.col("source").alias("node")).agg(size.alias("size")).unionByName(links.groupBy(F.col("target").alias("node")).agg(F.floor(size / 2).cast("long").alias("size")))
    return contracts.flow_violations(links, nodes)


@query("SELECT s_suppkey % 7 AS track, count(DISTINCT s_nationkey) AS n, count(DISTINCT s_nationkey) AS kinds FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) <> 25")
def complete_rectangle(spark, d):
    cells = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("track"), "s_nationkey").distinct()
    return contracts.rectangle_violations(cells, "track", "s_nationkey", 25)


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 49)")
def referential_integrity(spark, d):
    child = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return contracts.reference_violations(child, "l_partkey", table(spark, d, "part").where("p_size <= 49"), "p_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


# --- matching, ranking, supersession

_TEAM_SQL = """WITH pref AS (SELECT s_suppkey AS team_id, 'team ' || (s_suppkey % 60) AS name, s_suppkey % 5 AS track FROM supplier), proj AS (SELECT p_partkey AS project_id, 'team ' || (p_partkey * 3 // 4) AS name, p_partkey % 5 AS track FROM part),
 rev AS (SELECT s_suppkey AS team_id, s_suppkey + 10 AS project_id FROM supplier WHERE s_suppkey % 3 = 0), uniq AS (SELECT name, min(project_id) AS project_id, min(track) AS ptrack FROM proj GROUP BY name HAVING count(*) = 1),
 byname AS (SELECT team_id, project_id, 'name' AS how FROM pref JOIN uniq USING (name) WHERE track = ptrack), byrev AS (SELECT p.team_id, r.project_id, 'reviewed' AS how FROM pref p JOIN rev r USING (team_id) JOIN proj q ON q.project_id = r.project_id AND q.track = p.track WHERE p.team_id NOT IN (SELECT team_id FROM byname)),
 al AS (SELECT * FROM byname UNION ALL SELECT * FROM byrev) SELECT project_id, team_id, how FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY team_id) AS r FROM al) WHERE r = 1"""


@query(_TEAM_SQL)
def team_match(spark, d):
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    name = lambda c: text.team_name(F.concat(F.lit(" Team--"), c.cast("string")))
    prefs = s.select(F.col("s_suppkey").alias("team_id"), name(F.col("s_suppkey") % 60).alias("name"), (F.col("s_suppkey") % 5).alias("track"))
    projects = p.select(F.col("p_partkey").alias("project_id"), name(F.expr("p_partkey * 3 div 4")).alias("name"), (F.col("p_partkey") % 5).alias("track"))
    reviewed = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("team_id"), (F.col("s_suppkey") + 10).alias("project_id"))
    return matching.team_match(prefs, projects, reviewed)


@query("""WITH app AS (SELECT min(c_custkey) AS aid, c_custkey % 1200 AS e FROM customer GROUP BY 2) SELECT o_orderkey AS source_ref, CASE WHEN aid IS NOT NULL THEN 'exact' WHEN o_orderkey % 7 = 0 THEN 'reviewed' WHEN o_orderkey % 5 = 0 THEN 'quarantined' ELSE 'unresolved' END AS resolution,
 CASE WHEN aid IS NOT NULL THEN aid WHEN o_orderkey % 7 = 0 THEN o_custkey END AS application_id FROM orders LEFT JOIN app ON e = o_orderkey % 1500""")
def people_resolution(spark, d):
    o = table(spark, d, "orders")
    mail = lambda c, n: F.concat((F.col(c) % n).cast("string"), F.lit("@example.test"))
    apps = table(spark, d, "customer").select(F.col("c_custkey").alias("application_id"), mail("c_custkey", 1200).alias("email"))
    source = o.select(F.col("o_orderkey").alias("source_ref"), mail("o_orderkey", 1500).alias("email"))
    reviewed = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("source_ref"), F.col("o_custkey").alias("application_id"))
    return matching.people_resolution(source, apps, reviewed, o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("source_ref")))


@query("SELECT o_custkey AS person_id, max(o_orderkey) AS id, arg_max(o_orderpriority, o_orderkey) AS decision FROM orders GROUP BY 1")
def canonical_person(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("decision"))
    return matching.latest(o, ["person_id"], "id", "decision")


@query("SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS supersedes, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_current FROM conversations")
def supersession_current(spark, d):
    log = table(spark, d, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("id"))
    chained = matching.superseding(log, ["conv_id"], "id")
    now = matching.current(chained, "id").select("id", F.lit(True).alias("is_current"))
    return chained.join(now, "id", "left").select("conv_id", "turn", "role", F.col("supersedes.turn").alias("supersedes"), F.coalesce("is_current", F.lit(False)).alias("is_current"))


@query("SELECT o_custkey AS person_id, o_orderkey AS source_record_id FROM orders UNION SELECT user_id, event_id FROM events UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def person_source_links(spark, d):
    t = lambda n, a, b: table(spark, d, n).select(F.col(a).alias("person_id"), F.col(b).alias("source_record_id"))
    return matching.person_source_links(("orders", t("orders", "o_custkey", "o_orderkey")), ("events", t("events", "user_id", "event_id")), ("lineitem", t_returned(spark, d)))


def t_returned(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("source_record_id"))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS team, p_partkey AS project, p_size AS engagement, CAST(floor(p_retailprice) AS BIGINT) AS recency FROM lineitem JOIN part ON p_partkey = l_partkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY engagement DESC, recency DESC, project) AS a, row_number() OVER (PARTITION BY team ORDER BY recency DESC, engagement DESC, project) AS b FROM x),
 o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY CASE WHEN a <= 3 THEN a WHEN b <= 3 THEN 3 + b ELSE 6 + a END) AS place FROM r) SELECT team, project, engagement, recency, place FROM o WHERE place <= 6""")
def top_k_dual(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("project")).distinct()
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("project"), F.col("p_size").alias("engagement"), F.floor("p_retailprice").alias("recency"))
    return matching.dual_top(used.join(parts, "project"), ["team"], "engagement", "recency", "project", 3, 6).select("team", "project", "engagement", "recency", "place")


@query("""WITH c AS (SELECT o_orderkey AS pos, 'https://x.example/' || (o_custkey % 400) AS url, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS prio FROM orders),
 u AS (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY prio, pos) AS r FROM c) SELECT prio, pos, url FROM u WHERE r = 1 ORDER BY prio, pos LIMIT 100""")
def sampling_plan(spark, d):
    o = table(spark, d, "orders")
    c = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("https://x.example/"), (F.col("o_custkey") % 400).cast("string")).alias("url"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("prio"))
    return matching.sampling_plan(c, "url", "prio", "pos", 100)


@query("SELECT p_type AS cell, count(*) AS value FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1 HAVING count(*) >= 5 ORDER BY value DESC, cell LIMIT 6")
def ranked_items(spark, d):
    cells = table(spark, d, "part").groupBy(F.col("p_type").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return matching.ranked_items(suppress.p8_reviewed(cells.where(F.col("n") >= K), [], K).select("cell", "value"), ["ECONOMY"], 6)


# Records that share an identifier agree in the customer modulo 1,200: the SQL folds these blocks record by record.
@query("""WITH RECURSIVE all_ AS (SELECT c_custkey AS record, 0 AS place, c_custkey % 1200 AS block, 'm' || c_custkey % 1200 AS mail, CASE WHEN c_custkey % 11 = 0 THEN 'h' || c_custkey END AS handle, TRUE AS provided FROM customer
  UNION ALL SELECT o_orderkey + 1000000000, 1, o_custkey % 1200, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_custkey % 1200 END, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_custkey END, o_orderkey % 5 > 0 FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY place, record) AS i FROM all_),
 f AS (SELECT DISTINCT block, CAST(0 AS BIGINT) AS i, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS owners, CAST([] AS BIGINT[]) AS mailed, CAST([] AS STRUCT(h VARCHAR, p BIGINT)[]) AS seen,
   CAST(NULL AS BIGINT) AS record, CAST(NULL AS BIGINT) AS person, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS suggested FROM r
  UNION ALL SELECT block, i, CASE WHEN person IS NULL THEN owners ELSE map_concat(map_from_entries(list_transform(own, lambda k: {'k': k, 'v': person})), owners) END,
   CASE WHEN person IS NOT NULL AND mail IS NOT NULL THEN list_append(mailed, person) ELSE mailed END, CASE WHEN person IS NOT NULL AND handle IS NOT NULL THEN list_append(seen, {'h': handle, 'p': person}) ELSE seen END,
   record, person, CASE WHEN person IS NULL THEN 'quarantined' WHEN len(found) = 1 THEN 'merged' WHEN len(hints) > 0 THEN 'review' ELSE 'new' END,
   CASE WHEN person IS NULL THEN 'STRONG_IDENTIFIER_CONFLICT' WHEN len(found) = 0 THEN CASE WHEN len(hints) > 0 THEN 'PROFILE_EVIDENCE_NOT_BILATERAL' ELSE 'NO_STRONG_MATCH' END
    WHEN owners[held] IS NULL THEN 'EXACT_EMAIL' WHEN mail IS NOT NULL AND owners[mail] IS NULL AND list_contains(mailed, person) THEN 'BILATERAL_APPLICANT_PROFILE_EMAIL_MISMATCH' ELSE 'BILATERAL_APPLICANT_PROFILE' END,
   CASE WHEN len(found) = 0 THEN list_min(hints) END
  FROM (SELECT *, CASE len(found) WHEN 0 THEN record WHEN 1 THEN found[1] END AS person FROM (SELECT f.block, r.i, owners, mailed, seen, r.record, mail, handle, list_filter([mail, held], lambda k: k IS NOT NULL) AS own, held,
    list_distinct(list_filter([owners[mail], owners[held]], lambda p: p IS NOT NULL)) AS found, list_transform(list_filter(seen, lambda s: s.h = handle), lambda s: s.p) AS hints
    FROM f JOIN (SELECT *, CASE WHEN provided THEN handle END AS held FROM r) r ON r.block = f.block AND r.i = f.i + 1)))
 SELECT record, person, outcome, reason, suggested FROM f WHERE record IS NOT NULL""")
def identity_resolution(spark, d):
    """Guests and a second source with manufactured collisions, settled in the order of their records."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key, null = F.col("c_custkey"), F.lit(None).cast("string")
    mail = lambda k: F.concat((F.col(k) % 1200).cast("string"), F.lit("@x.test"))
    handle = lambda k: F.concat(F.lit("h"), F.col(k).cast("string"))
    both = F.array(F.lit("github"), F.lit("linkedin"))
    guests = c.select(key.alias("record"), F.lit(0).alias("place"), mail("c_custkey").alias("email"), F.when(key % 11 == 0, handle("c_custkey")).alias("github"), null.alias("linkedin"), both.alias("provided"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), null.alias("affiliation"))
    order = F.col("o_orderkey")
    later = o.select(
        (order + 1_000_000_000).alias("record"), F.lit(1).alias("place"), F.when(order % 2 == 0, mail("o_custkey")).alias("email"), F.when(order % 3 == 0, handle("o_custkey")).alias("github"), null.alias("linkedin"),
        F.when(order % 5 > 0, both).otherwise(F.array().cast("array<string>")).alias("provided"), null.alias("name"), null.alias("team"), null.alias("affiliation"),
    )
    return identity.resolve(guests.unionByName(later))


# --- scoring

_SCORE = """s AS (SELECT model, count(*) AS n, count(*) FILTER (e = 1 AND p = 1) AS tp, count(*) FILTER (e = 0 AND p = 1) AS fp, count(*) FILTER (e = 1 AND p = 0) AS fn, count(*) FILTER (e = 0 AND p = 0) AS tn FROM
 (SELECT unnest([{'model': 'short', 'p': (n_chars < 500)::INT}, {'model': 'long', 'p': (n_chars >= 500)::INT}, {'model': 'english', 'p': (lang = 'en')::INT}], recursive := true), toxic AS e FROM labels JOIN documents USING (doc_id)) GROUP BY model),
 b AS (SELECT *, CASE WHEN tp + fp = 0 THEN 10000 ELSE tp * 10000 // (tp + fp) END AS precision_bp, CASE WHEN tp + fn = 0 THEN 10000 ELSE tp * 10000 // (tp + fn) END AS recall_bp, CASE WHEN n = 0 THEN 10000 ELSE (tp + tn) * 10000 // n END AS agreement_bp FROM s)"""


def _scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    rows = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("expected")).join(docs, "doc_id")
    models = {"short": F.col("n_chars") < 500, "long": F.col("n_chars") >= 500, "english": F.col("lang") == "en"}
    rows = rows.select("expected", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.coalesce(c, F.lit(False)).cast("int").alias("predicted")) for k, c in models.items()])).alias("m"))
    return scoring.scores(rows.select("expected", "m.*"))


@query(f"WITH {_SCORE} SELECT model, n, tp, fp, fn, tn, precision_bp, recall_bp, agreement_bp FROM b")
def model_scores(spark, d):
    return _scores(spark, d)


@query(f"WITH {_SCORE} SELECT CASE WHEN count(*) FILTER (recall_bp >= 1000) > 0 THEN arg_min(model, (-agreement_bp, -recall_bp)) FILTER (recall_bp >= 1000) END AS model, CASE WHEN count(*) FILTER (recall_bp >= 1000) = 0 THEN 'recall' ELSE 'selected' END AS reason FROM b")
def model_selection(spark, d):
    cascade = [("complete", F.col("n") > 0), ("recall", F.col("recall_bp") >= 1000)]
    return scoring.selected(_scores(spark, d), cascade, [-F.col("agreement_bp"), -F.col("recall_bp")], "model")


# --- scalar functions


@query("""WITH v AS (SELECT p_partkey, p_size * 20 AS age, p_size * 8 AS rec, CAST(floor(p_retailprice) AS BIGINT) * 17 AS size, p_size % 120 AS stars FROM part) SELECT p_partkey, CASE WHEN age < 180 THEN 'new' WHEN age < 1095 THEN 'established' ELSE 'mature' END AS age_band,
 CASE WHEN rec <= 90 THEN 'active_90d' WHEN rec <= 365 THEN 'active_365d' ELSE 'stale' END AS recency_band, CASE WHEN size < 300 THEN 'tiny' WHEN size < 3000 THEN 'small' WHEN size < 30000 THEN 'medium' ELSE 'large' END AS size_band,
 CASE WHEN stars = 0 THEN 'none' WHEN stars < 10 THEN 'some' WHEN stars < 100 THEN 'notable' ELSE 'high' END AS stars_band, least(stars, 100000) * 3 + least(p_partkey, 100000) * 5 AS engagement, greatest(0, 100000 - rec) AS recency FROM v""")
def project_bands(spark, d):
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("age"), (F.col("p_size") * 8).alias("rec"), (F.floor("p_retailprice") * 17).alias("size"), (F.col("p_size") % 120).alias("stars"))
    c = F.col
    return v.select("p_partkey", text.age_band(c("age")).alias("age_band"), text.recency_band(c("rec")).alias("recency_band"), text.size_band(c("size")).alias("size_band"), text.count_band(c("stars")).alias("stars_band"), text.engagement(c("stars"), c("p_partkey")).alias("engagement"), text.recency(c("rec")).alias("recency"))


def _label_sql(dimension: str, none: str, extra: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> str:
    rules = {k: _has("t", p) for k, p in text.TRIGGERS.get(dimension, {}).items()} | (extra or {})
    found = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in sorted(rules.items()))
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ','), ''), '{none}')"


_FOUNDER = _has("t", text.TRIGGERS["professional_identity"]["founder_cofounder"])
_CLASSIFY = f"""WITH raw AS (SELECT doc_id, lower(coalesce(text, '')) AS x, lower(coalesce(source, '')) AS org, doc_id % 3 = 0 AS gh FROM documents), a AS (SELECT *, ' ' || x || '  ' || org AS t FROM raw),
 y AS (SELECT *, list_max(list_transform(regexp_extract_all(t, '{B}(\\d{{1,2}})\\+?\\s+years?{E}', 1), lambda v: CAST(v AS INT))) AS years FROM a),
 s AS (SELECT *, CASE WHEN {_FOUNDER} THEN 'founder' WHEN {_has("t", text.STUDENT)} THEN 'student' WHEN {_has("t", text.JUNIOR)} THEN 'junior' WHEN years >= 6 THEN 'senior' WHEN years >= 3 THEN 'mid_level' WHEN years IS NOT NULL THEN 'junior' ELSE 'unknown' END AS seniority FROM y),
 l AS (SELECT doc_id, {_label_sql("professional_identity", "insufficient_evidence")} AS professional_identity, seniority, {_label_sql("functional_role", "unknown")} AS functional_role,
 CASE WHEN {_FOUNDER} THEN 'self_employed_founder' WHEN seniority = 'student' THEN 'student_no_employer' WHEN {_has("org", text.ACADEMIC)} THEN 'academia_research' ELSE 'unknown' END AS employer_pedigree,
 {_label_sql("builder_evidence", "insufficient_evidence", {"founded_company": _FOUNDER, "shipped_product": _has("x", text.SHIPPED), "github_supplied": "gh"})} AS builder_evidence, {_label_sql("capabilities", "unknown")} AS capabilities, {_label_sql("domains", "unknown")} AS domains FROM s)"""
DIMENSIONS = text.DIMENSIONS


def _classified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return text.classified(views.spread(docs), F.lit(""), F.col("text"), F.lit(""), F.col("source"), F.col("doc_id") % 3 == 0).drop("text", "source")


@query(_CLASSIFY + " SELECT * FROM l")
def classify_text(spark, d):
    return _classified(spark, d).select("doc_id", *[F.array_join(k, ",").alias(k) for k in DIMENSIONS])


@query(_CLASSIFY + " SELECT dimension, label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, unnest(string_split({k}, ',')) AS label FROM l" for k in DIMENSIONS) + ") GROUP BY ALL")
def label_distribution(spark, d):
    def tagged(dimension):
        return F.transform(dimension, lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("label")))

    labels = F.flatten(F.array(*map(tagged, DIMENSIONS)))
    return _classified(spark, d).select(F.explode(labels).alias("x")).groupBy("x.dimension", "x.label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type || '  & ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unclassified') AS track FROM part")
def track_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.track(F.concat("p_type", F.lit("  & "), "p_name", F.lit("!"))).alias("track"))


@query("SELECT c_custkey, lower(c_name) || '@example.test' AS email, left(c_name, 1) || '***@Example.Test' AS masked, TRUE AS valid FROM customer")
def email_normalise(spark, d):
    raw = F.concat(F.lit("  "), "c_name", F.lit("@Example.Test \t"))
    return table(spark, d, "customer").select("c_custkey", text.email(raw).alias("email"), text.mask_email(text.strip(raw)).alias("masked"), text.valid_email(text.email(raw)).alias("valid"))


@query("SELECT c_custkey, 'person_' || sha256('event-1') || '_' || sha256('event-1' || chr(0) || 'person' || chr(0) || 'key' || chr(0) || c_custkey) AS ref FROM customer")
def stable_reference(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.stable_reference(F.lit("event-1"), F.lit("person"), F.lit("key"), F.col("c_custkey").cast("string")).alias("ref"))


_PADS = ["".join(f"\\x{b ^ p:02X}" for b in b"fixture-key".ljust(64, b"\0")) for p in (0x36, 0x5C)]


@query(f"SELECT c_custkey, 'pid:v1:' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(lower(c_name))))) AS pid FROM customer")
def hmac_pseudonym(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.pseudonym(F.col("c_name"), b"fixture-key", "v1").alias("pid"))


@query("SELECT c_nationkey AS nation, count(*) FILTER (c_acctbal > 0) || ' of ' || count(*) || ' (' || CAST(round_even(count(*) FILTER (c_acctbal > 0) / count(*) * 100, 0) AS BIGINT) || '%)' AS line, regexp_replace(printf('%.6f', count(*) FILTER (c_acctbal > 0) / count(*) * 100), '\\.?0+$', '') AS exact FROM customer GROUP BY 1")
def count_lines(spark, d):
    found = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("c_acctbal") > 0).alias("n"), F.count(F.lit(1)).alias("d"))
    return found.select("nation", text.count_line(F.col("n"), F.col("d")).alias("line"), text.exact_percentage(F.col("n"), F.col("d")).alias("exact"))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'email' WHEN regexp_matches(text, '(?i)\bhttps?://|\bwww\.') THEN 'url' WHEN regexp_matches(text, '\bpid:[a-z0-9]+:[0-9a-f]{64}\b') THEN 'pseudonym' WHEN regexp_matches(text, '(?:\d{1,3}\.){3}\d{1,3}') THEN 'address' ELSE 'none' END AS kind FROM documents) GROUP BY 1""")
def pii_scan(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce(text.pii_kind(F.col("text")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def sanitise_text(spark, d):
    from cohortlens.functions.redaction import sanitised_of

    return views.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", sanitised_of(F.col("text")).alias("text"))


@query()
def visible_text(spark, d):
    from cohortlens.functions.python_text import visible_text as visible

    return table(spark, d, "pages").select("page_id", visible("html").alias("text"))


# --- lifecycle


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY THEN o_orderpriority END AS payload, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND o_orderpriority IS NOT NULL AS erased FROM orders")
def retention_cleanup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("payload"), "o_orderdate")
    return lifecycle.retained(o, "o_orderdate", "payload", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "payload", "erased")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def rights_latest(spark, d):
    return lifecycle.rights_latest(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("state")), "user_id", "event_id", "state")


@query("WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1) SELECT c_custkey FROM customer JOIN r ON user_id = c_custkey WHERE state IN ('click', 'view')")
def publishable_members(spark, d):
    members = table(spark, d, "customer").select("c_custkey")
    return lifecycle.publishable(members, rights_latest(spark, d).withColumnRenamed("user_id", "c_custkey"), "c_custkey", "state", ["click", "view"])


@query("""WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1) SELECT o_orderkey AS asset_id, o_custkey AS subject, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN 'use_not_allowed' WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'expired'
 WHEN state IS NULL OR state = 'purchase' THEN 'subject_excluded' WHEN o_orderstatus = 'P' THEN 'not_approved' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'outside_window' ELSE 'allowed' END AS decision FROM orders LEFT JOIN r ON user_id = o_custkey""")
def asset_use(spark, d):
    o = table(spark, d, "orders")
    uses = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, "report"), F.when(F.col("o_orderkey") % 2 == 0, "report")))
    assets = o.select(F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("subject"), uses.alias("allowed_uses"), F.lit("report").alias("wanted_use"), F.col("o_orderdate").alias("expires_at"))
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    late = F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")
    approvals = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("asset_id"), F.when(late, F.lit("1999-01-01").cast("timestamp_ntz")).otherwise(now).alias("approved_from"), F.lit("2000-01-01").cast("timestamp_ntz").alias("approved_until"))
    rights = rights_latest(spark, d).select(F.col("user_id").alias("subject"), F.when(F.col("state") == "purchase", "excluded").otherwise(F.col("state")).alias("state"))
    return lifecycle.asset_use(assets, approvals, rights, now)


@query("""WITH e AS (SELECT l_suppkey AS release, CASE l_linenumber % 4 WHEN 0 THEN 'inventory' WHEN 1 THEN 'parity' WHEN 2 THEN 'review' ELSE 'approval' END AS kind, l_quantity > 1 AS ok FROM lineitem)
 SELECT release, CASE WHEN bool_or(kind IN ('inventory', 'parity') AND NOT ok) THEN 'Blocked' WHEN bool_or(kind = 'review' AND NOT ok) OR NOT bool_or(kind = 'approval' AND ok) THEN 'Needs review' ELSE 'Safe' END AS state FROM e GROUP BY 1""")
def release_state(spark, d):
    m = F.col("l_linenumber") % 4
    li = table(spark, d, "lineitem")
    kind = F.when(m == 0, "inventory").when(m == 1, "parity").when(m == 2, "review").otherwise("approval")
    return lifecycle.release_state(li.select(F.col("l_suppkey").alias("release"), kind.alias("kind"), (F.col("l_quantity") > 1).alias("ok")), ["release"])


@query("WITH a AS (SELECT o_orderkey AS arrival, CAST(o_custkey % 700 AS VARCHAR) AS digest, o_orderpriority AS source_type, o_orderstatus AS event FROM orders), m AS (SELECT CAST(c_custkey AS VARCHAR) AS digest, '1-URGENT' AS source_type, 'F' AS event FROM customer) SELECT digest, source_type, event, min(arrival) AS arrival FROM a ANTI JOIN m USING (digest, source_type, event) GROUP BY ALL")
def ingest_idempotence(spark, d):
    arrivals = table(spark, d, "orders").select(F.col("o_orderkey").alias("arrival"), (F.col("o_custkey") % 700).cast("string").alias("digest"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderstatus").alias("event"))
    manifest = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("digest"), F.lit("1-URGENT").alias("source_type"), F.lit("F").alias("event"))
    return lifecycle.new_files(arrivals, manifest)


# --- interaction events

_ALLOW = {"click": ["k"], "view": [], "purchase": ["k"]}


@query("SELECT event_id, event_type AS event, CASE WHEN event_type = 'view' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def interaction_allowlist(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.from_json("props", "map<string,string>").alias("props"))
    return interactions.allowed(e, _ALLOW).select("event_id", "event", F.try_element_at("props", F.lit("k")).alias("k"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def interaction_windows(spark, d):
    e = table(spark, d, "events").select("ts", F.col("event_type").alias("event"), "value")
    return interactions.windowed(e).select(F.col("w.start").alias("start"), "event", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sess""")
def interaction_sessions(spark, d):
    return interactions.sessions(table(spark, d, "events").select("ts", "user_id")).select("user_id", F.col("w.start").alias("start"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from cohortlens.plans import event_queries, evidence_queries, population_queries, record_queries, review_queries, upload_queries  # noqa: E402, F401  they register themselves
