"""Named queries over an event built from orders and lines, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import eventbuild, journeys, scoring
from cohortlens.operators.eventbuild import Source
from cohortlens.plans.queries import query
from cohortlens.plans.views import table

EVENT = "event-1"


def _ref(kind: str, how: str, value: str) -> str:
    return f"'{kind}_' || sha256('{EVENT}') || '_' || sha256('{EVENT}' || chr(0) || '{kind}' || chr(0) || '{how}' || chr(0) || {value})"


#: All rows of all sources, with what is wrong with each.
_ROWS = f"""src AS (SELECT 'applications' AS role, CAST(c_custkey AS BIGINT) AS row_number, 'a' || c_custkey // 2 AS id, 'p' || c_custkey AS who, NULL AS yes, FALSE AS present, c_custkey % 3 = 0 AS github, NULL AS team, NULL AS project, NULL AS track, NULL AS repository, c_custkey % 13 = 0 AS bad FROM customer WHERE c_acctbal > 0
 UNION ALL SELECT 'attendance', o_orderkey, 'b' || o_orderkey, 'p' || o_custkey, o_orderstatus = 'F', o_orderpriority = '1-URGENT', FALSE, NULL, NULL, NULL, NULL, FALSE FROM orders
 UNION ALL SELECT 'teams', o_orderkey, 'c' || o_orderkey, 'p' || o_custkey, NULL, FALSE, FALSE, CASE WHEN o_orderkey % 13 > 0 THEN 'T' || o_orderkey // 8 END, NULL, CASE WHEN o_orderkey % 101 = 0 THEN 'other' ELSE 'k' || o_orderkey // 8 % 4 END, NULL, FALSE FROM orders
 UNION ALL SELECT 'submissions', l_orderkey * 10 + l_linenumber, 'd' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey % 1500, l_orderkey % 2 = 0 AND l_quantity < 50, FALSE, FALSE, CASE WHEN l_orderkey % 3 > 0 THEN 'T' || l_orderkey // 8 END, CASE WHEN l_linenumber < 7 THEN 'P' || l_orderkey END, 'k' || l_orderkey // 8 % 4, l_orderkey % 5 = 0, FALSE FROM lineitem),
 dup AS (SELECT id FROM src WHERE role = 'applications' AND NOT bad GROUP BY id HAVING count(*) > 1), pop AS (SELECT who FROM src WHERE role = 'applications' AND NOT bad AND id NOT IN (SELECT id FROM dup)),
 r1 AS (SELECT *, CASE WHEN bad THEN 'missing_stable_id' WHEN role = 'applications' AND id IN (SELECT id FROM dup) THEN 'doubled_record' WHEN who NOT IN (SELECT who FROM pop) THEN 'invalid_relation' WHEN role = 'teams' AND team IS NULL OR role = 'submissions' AND project IS NULL THEN 'malformed_record' END AS p1 FROM src),
 ct AS (SELECT team FROM r1 WHERE p1 IS NULL AND team IS NOT NULL GROUP BY 1 HAVING count(DISTINCT track) > 1), cp AS (SELECT project FROM r1 WHERE p1 IS NULL AND project IS NOT NULL GROUP BY 1 HAVING count(DISTINCT yes) > 1),
 r AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN p1 WHEN team IN (SELECT team FROM ct) THEN 'team' WHEN project IN (SELECT project FROM cp) THEN 'project' END AS problem, {_ref("applicant", "canonical_content_key", "who")} AS applicant_ref, CASE WHEN team IS NOT NULL THEN {_ref("team", "provider_id", "team")} END AS team_ref,
  CASE WHEN project IS NOT NULL THEN {_ref("project", "provider_id", "project")} END AS project_ref FROM r1), kept AS (SELECT * FROM r WHERE problem IS NULL)"""


def event(spark, d) -> dict[str, DataFrame]:
    """Customers apply (record ids of neighbours are the same), orders are attendance and teams, lines are submissions."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    sheet, who = F.lit("S").alias("source_partition"), lambda of: text("p", of).alias("applicant_identity")
    people = table(spark, d, "customer").where("c_acctbal > 0")
    applications = people.where(c % 13 > 0).select(c.alias("row_number"), sheet, text("a", F.expr("c_custkey div 2")).alias("external_record_id"), who(c), F.when(c % 3 == 0, " g ").otherwise("  ").alias("github"))
    attendance = o.select(
        k.alias("row_number"), sheet, text("b", k).alias("external_record_id"), who(F.col("o_custkey")), F.when(F.col("o_orderstatus") == "F", " Approved").otherwise("other").alias("approval_status"), F.when(F.col("o_orderpriority") == "1-URGENT", "12:00").alias("checked_in_at"),
    )
    track = lambda key: text("k", F.expr(f"{key} div 8 % 4"))
    teams = o.select(
        k.alias("row_number"), sheet, text("c", k).alias("external_record_id"), who(F.col("o_custkey")), F.when(k % 13 > 0, text("T", F.expr("o_orderkey div 8"))).otherwise(" ").alias("team_id"), F.when(k % 101 == 0, "other").otherwise(track("o_orderkey")).alias("track"),
    )
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    submissions = line.select(
        (key * 10 + number).alias("row_number"), sheet, text("d", key, "-", number).alias("external_record_id"), who(F.col("l_partkey") % 1500), F.when((key % 2 == 0) & (F.col("l_quantity") < 50), "SUBMITTED").otherwise("draft").alias("submission_status"),
        F.when(key % 3 > 0, text("T", F.expr("l_orderkey div 8"))).alias("team_id"), F.when(number < 7, text("P", key)).alias("project_id"), track("l_orderkey").alias("track"), F.when(key % 5 == 0, "r").alias("repository"),
    )
    return eventbuild.build(spark, EVENT, {
        "applications": Source(applications, people.where(c % 13 == 0).select(c.alias("row_number"), sheet), required=True, unique_ids=True),
        "attendance": Source(attendance, positive=("approved",)), "teams": Source(teams), "submissions": Source(submissions, positive=("submitted",)),
    })


@query(f"""WITH {_ROWS} SELECT role, count(*) AS n_in, count(*) FILTER (problem IS NULL) AS n_kept, count(*) FILTER (problem IN ('missing_stable_id', 'invalid_relation', 'malformed_record')) AS n_rejected, count(*) FILTER (problem IN ('doubled_record', 'team', 'project')) AS n_conflicts FROM r GROUP BY 1""")
def event_accounts(spark, d):
    return eventbuild.accounts(event(spark, d)["outcomes"])


@query(f"WITH {_ROWS} SELECT role, row_number, problem FROM r WHERE problem IS NOT NULL")
def event_problems(spark, d):
    return event(spark, d)["outcomes"].where("problem is not null").select("role", "row_number", "problem")


@query(f"WITH {_ROWS} SELECT applicant_ref, bool_or(github) AS github_supplied, count(DISTINCT role || id) AS n_sources FROM r WHERE problem IS NULL OR problem = 'malformed_record' GROUP BY 1")
def event_applicants(spark, d):
    return event(spark, d)["applicants"]


@query(f"WITH {_ROWS} SELECT applicant_ref, {_ref('source_record', 'provider_id', "'attendance:' || id")} AS source_ref, CASE WHEN yes THEN TRUE END AS accepted, CASE WHEN present THEN TRUE END AS present FROM kept WHERE role = 'attendance'")
def event_attendance(spark, d):
    return event(spark, d)["attendance"]


@query(f"""WITH {_ROWS} SELECT DISTINCT 'team' AS kind, team_ref AS ref, CAST(NULL AS VARCHAR) AS team_ref, track, CAST(NULL AS BOOLEAN) AS submitted, CAST(NULL AS BOOLEAN) AS repository_supplied FROM kept WHERE team IS NOT NULL
 UNION ALL SELECT DISTINCT 'project', project_ref, team_ref, track, CASE WHEN yes THEN TRUE END, repository FROM kept WHERE role = 'submissions'""")
def event_teams_and_projects(spark, d):
    found = event(spark, d)
    no = F.lit(None).cast("boolean")
    teams = found["teams"].select(F.lit("team").alias("kind"), F.col("team_ref").alias("ref"), F.lit(None).cast("string").alias("team_ref"), "track", no.alias("submitted"), no.alias("repository_supplied"))
    return teams.unionByName(found["projects"].select(F.lit("project").alias("kind"), F.col("project_ref").alias("ref"), "team_ref", "track", "submitted", "repository_supplied"))


@query(f"WITH {_ROWS} SELECT DISTINCT 'team' AS kind, team_ref AS ref, applicant_ref FROM kept WHERE role = 'teams' UNION ALL SELECT DISTINCT 'project', project_ref, applicant_ref FROM kept WHERE role = 'submissions' AND yes")
def event_members(spark, d):
    found = event(spark, d)
    sides = {"team": "team_members", "project": "project_members"}
    teams, projects = (found[t].select(F.lit(kind).alias("kind"), F.col(f"{kind}_ref").alias("ref"), "applicant_ref") for kind, t in sides.items())
    return teams.unionByName(projects)


@query("""WITH t AS (SELECT o_orderkey AS team_ref, o_custkey AS applicant_ref FROM orders), a AS (SELECT c_custkey AS applicant_ref FROM customer WHERE c_acctbal > 0), p AS (SELECT l_orderkey AS project_ref FROM lineitem WHERE l_linenumber = 2), m AS (SELECT l_orderkey AS project_ref, l_linenumber % 2 AS applicant_ref FROM lineitem)
 SELECT 'team_members: unknown applicant_ref' AS rule, applicant_ref AS ref FROM t WHERE applicant_ref NOT IN (SELECT applicant_ref FROM a) UNION ALL SELECT 'attendance: unknown applicant_ref', applicant_ref FROM t WHERE applicant_ref NOT IN (SELECT applicant_ref FROM a)
 UNION ALL SELECT 'team_members: unknown team_ref', team_ref FROM t WHERE team_ref % 10 = 0 UNION ALL SELECT 'projects: unknown team_ref', project_ref FROM p WHERE project_ref % 10 = 0 OR project_ref NOT IN (SELECT team_ref FROM t)
 UNION ALL SELECT 'project_members: unknown project_ref', project_ref FROM m WHERE project_ref NOT IN (SELECT project_ref FROM p WHERE project_ref % 3 > 0) UNION ALL SELECT 'project_members: unknown applicant_ref', applicant_ref FROM m WHERE applicant_ref NOT IN (SELECT applicant_ref FROM a)
 UNION ALL SELECT 'project_members: doubled', project_ref FROM (SELECT * FROM m GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'projects: doubled', project_ref FROM p GROUP BY 2 HAVING count(*) > 1""")
def event_integrity(spark, d):
    """Tables that weren't built together: orders as teams, lines as members of projects."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    members = o.select(F.col("o_orderkey").alias("team_ref"), F.col("o_custkey").alias("applicant_ref"))
    projects = line.where("l_linenumber = 2").select(F.col("l_orderkey").alias("project_ref"), F.col("l_orderkey").alias("team_ref"), (F.col("l_orderkey") % 3 > 0).alias("submitted"))
    return eventbuild.integrity({
        "applicants": table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("applicant_ref")), "teams": o.where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("team_ref")), "projects": projects,
        "team_members": members, "attendance": members, "project_members": line.select(F.col("l_orderkey").alias("project_ref"), (F.col("l_linenumber") % 2).cast("long").alias("applicant_ref")),
    })


@query("""WITH c AS (SELECT o_custkey AS journey, count(*) AS applied, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus <> 'F') AS others, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS came FROM orders GROUP BY 1),
 nodes AS (SELECT journey, 'applied' AS node, 1 AS place, applied AS size FROM c UNION ALL SELECT journey, 'going_accepted', 2, CASE WHEN journey % 4 > 0 THEN accepted END FROM c UNION ALL SELECT journey, 'not_accepted_reason_unknown', 3, CASE WHEN journey % 8 > 1 THEN others END FROM c UNION ALL SELECT journey, 'on_site', 4, came FROM c),
 links AS (SELECT journey, 'applied' AS source, 'going_accepted' AS target, CASE WHEN journey % 7 > 0 THEN accepted END AS n FROM c UNION ALL SELECT journey, 'applied', 'not_accepted_reason_unknown', CASE WHEN journey % 14 > 0 THEN others END FROM c UNION ALL SELECT journey, 'going_accepted', CASE WHEN journey % 10 = 0 THEN 'lost' ELSE 'on_site' END, CASE WHEN journey % 5 = 1 THEN came + 2 ELSE came END FROM c
  UNION ALL SELECT journey, 'on_site', 'applied', 1 FROM c WHERE journey % 9 = 0),
 e AS (SELECT l.*, a.size AS s, b.size AS t, a.place AS sp, b.place AS tp, b.node IS NOT NULL AS known FROM links l LEFT JOIN nodes a ON a.journey = l.journey AND a.node = l.source LEFT JOIN nodes b ON b.journey = l.journey AND b.node = l.target),
 o AS (SELECT n.journey, n.node, n.size, count(*) AS links, count(*) FILTER (l.n IS NULL) AS hidden, coalesce(sum(l.n), 0) AS flow FROM nodes n JOIN links l ON l.journey = n.journey AND l.source = n.node GROUP BY ALL),
 i AS (SELECT n.journey, n.node, n.size, coalesce(sum(l.n), 0) AS flow FROM nodes n JOIN links l ON l.journey = n.journey AND l.target = n.node GROUP BY ALL),
 p AS (SELECT journey, max(size) FILTER (node = 'applied') AS size, count(*) FILTER (node IN ('going_accepted', 'not_accepted_reason_unknown') AND size IS NULL) AS hidden, coalesce(sum(size) FILTER (node IN ('going_accepted', 'not_accepted_reason_unknown')), 0) AS shown FROM nodes GROUP BY 1)
 SELECT journey, source || '->' || target AS at, 'unknown node' AS problem FROM e WHERE NOT known UNION ALL SELECT journey, source || '->' || target, 'not forward' FROM e WHERE sp >= tp UNION ALL SELECT journey, source || '->' || target, 'more than an end' FROM e WHERE n > s OR n > t
 UNION ALL SELECT journey, source || '->' || target, 'small nested remainder' FROM e WHERE n IS NOT NULL AND s - t BETWEEN 1 AND 2 UNION ALL SELECT journey, source || '->' || target, 'not its target''s count' FROM e WHERE known AND n IS DISTINCT FROM t
 UNION ALL SELECT journey, node, 'outgoing above the node' FROM o WHERE flow > size UNION ALL SELECT journey, node, 'incoming above the node' FROM i WHERE flow > size
 UNION ALL SELECT journey, node, 'single withheld part' FROM o WHERE size IS NOT NULL AND links >= 2 AND hidden = 1 UNION ALL SELECT journey, node, 'small withheld remainder' FROM o WHERE hidden > 0 AND size - flow BETWEEN 1 AND 2
 UNION ALL SELECT journey, 'applied', 'single withheld part' FROM p WHERE hidden = 1 UNION ALL SELECT journey, 'applied', 'small withheld remainder' FROM p WHERE hidden > 0 AND size - shown BETWEEN 1 AND 2
 UNION ALL SELECT journey, NULL, 'open topology' FROM c WHERE journey % 9 = 0 OR journey % 10 = 0""")
def journey_contract(spark, d):
    """Each customer's orders as a journey, some with counts withheld or changed and with links that lead elsewhere."""
    j = F.col("journey")
    f = F.col("o_orderstatus") == "F"
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("journey")).agg(F.count(F.lit(1)).alias("applied"), F.count_if(f).alias("accepted"), F.count_if(~f).alias("others"), F.count_if(f & (F.col("o_orderpriority") != "5-LOW")).alias("came"))
    row = lambda *cells: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(f"c{i}") for i, c in enumerate(cells)])
    nodes = F.array(row("applied", 1, F.col("applied")), row("going_accepted", 2, F.when(j % 4 > 0, F.col("accepted"))), row("not_accepted_reason_unknown", 3, F.when(j % 8 > 1, F.col("others"))), row("on_site", 4, F.col("came")))
    links = [
        row("applied", F.lit("going_accepted"), F.when(j % 7 > 0, F.col("accepted"))), row("applied", F.lit("not_accepted_reason_unknown"), F.when(j % 14 > 0, F.col("others"))),
        row("going_accepted", F.when(j % 10 == 0, "lost").otherwise("on_site"), F.when(j % 5 == 1, F.col("came") + 2).otherwise(F.col("came"))), F.when(j % 9 == 0, row("on_site", F.lit("applied"), F.lit(1).cast("long"))),
    ]
    flat = lambda c, *names: counts.select("journey", F.explode(c).alias("r")).select("journey", *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    return journeys.violations(flat(nodes, "node", "place", "size"), flat(F.array_compact(F.array(*links)), "source", "target", "n"), 3, real=True)


def _recommended_sql(t: int) -> str:
    steps = [
        ("coverage = 10000", "no_model_met_mandatory_review_coverage"), ("labels > 0", "no_model_met_partner_taxonomy_gold_support_requirement"), ("metrics > 0", "no_model_met_partner_metric_gold_support_requirement"),
        (f"v6 >= {t}", "no_model_met_impressive_agreement_threshold"), (f"v0 >= {t}", "no_model_met_report_scalar_agreement_threshold"), (f"v1 >= {t - 1000}", "no_model_met_report_scalar_minimum_floor"),
        (f"v2 >= {t}", "no_model_met_partner_metric_precision_threshold"), (f"v3 >= {t}", "no_model_met_partner_metric_recall_threshold"), (f"v4 >= {t}", "no_model_met_partner_taxonomy_precision_threshold"),
        (f"v5 >= {t - 1000}", "no_model_met_partner_taxonomy_recall_floor"), ("failed = 0", "no_model_met_zero_failure_requirement"), ("yes > 0 AND no > 0", "no_model_met_impressive_gold_class_diversity_requirement"),
    ]
    passed = [" AND ".join(c for c, _ in steps[: i + 1]) for i in range(len(steps))]
    reasons = " ".join(f"WHEN count(*) FILTER ({c}) = 0 THEN '{reason}'" for c, (_, reason) in zip(passed, steps))
    done = "proposal_quality_thresholds_met_mandatory_human_review_before_release_ranked_by_quality_then_escalation_then_cost"
    return f"SELECT {t} AS threshold, arg_min(model, (-v0, -v1, -v2, -v3, -v4, -v5, -v6, escalated, cost)) FILTER ({passed[-1]}) AS model, CASE {reasons} ELSE '{done}' END AS reason FROM r"


_THRESHOLDS = [2000, 5000, 7000, 8000, 9500, 10000]


@query(f"""WITH g AS (SELECT coalesce(source, 'none') AS model, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS s FROM documents GROUP BY 1), r AS (SELECT model, CASE WHEN n % 5 = 0 THEN 9999 ELSE 10000 END AS coverage, n % 7 AS labels, s % 11 AS metrics, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS failed, n % 4 AS yes, s % 4 AS no,
 {", ".join(f"s * {i + 1} % 4000 + 6000 AS v{i}" for i in range(7))}, s % 100 AS escalated, s AS cost FROM g) {" UNION ALL ".join(map(_recommended_sql, _THRESHOLDS))}""")
def model_recommendation(spark, d):
    """Sources as models, with scores from their sizes, at several thresholds."""
    n, s = F.col("n"), F.col("s")
    score = lambda i: (s * (i + 1) % 4000 + 6000)
    reports = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("s"))
    reports = reports.select(
        "model", F.when(n % 5 == 0, 9999).otherwise(10000).alias("mandatory_review_coverage_basis_points"), (n % 7).alias("partner_taxonomy_expected_positive_count"), (s % 11).alias("partner_metric_expected_positive_count"), F.when(n % 3 == 0, 1).otherwise(0).alias("failed_attempt_count"),
        (n % 4).alias("impressive_expected_positive_count"), (s % 4).alias("impressive_expected_negative_count"), *[score(i).alias(c) for i, c in enumerate(scoring.MORE_IS_BETTER)], (s % 100).alias(scoring.LESS_IS_BETTER[0]), s.alias(scoring.LESS_IS_BETTER[1]),
    )
    found = [scoring.recommended(reports, t).select(F.lit(t).alias("threshold"), "model", "reason") for t in _THRESHOLDS]
    return reduce(DataFrame.unionByName, found)
