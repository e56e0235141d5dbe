"""Named queries over evidence and scalar rules, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import evidence as ev
from cohortlens.functions import text
from cohortlens.operators import aggregate, contracts, evidence
from cohortlens.plans import views
from cohortlens.plans.queries import query
from cohortlens.plans.views import FACTS, table

TITLES = ["Founder & CEO", "Chief Architect", "Principal Engineer", "Staff Designer", "Director of Data", "Head of Growth", "Team Lead", "Senior Analyst", "Junior Developer", "Entry trainee", "Mid-level Engineer", "VP Sales", "Baker", ""]
INDUSTRIES = ["Computer Software", "Banking", "Higher Education", "Medical Devices", "Research", "Management Consulting", "Automotive", "Farming", ""]
SIZES = ["Self-employed", "1", "2-10 employees", "11-50", "501-1,000 employees", "1001-5,000", "5001-10,000", "10,001+", "many", "", "99999999999999999999"]
KINDS = ["University", "Venture Backed", "Scale-up", "Start-up", "Public Company", "Privately held"]
TOPIC_LISTS = [["LLM", "rag", "cli"], ["edtech", "unheard"], [], ["Health", "healthcare", "ai"]]
LANGUAGE_NAMES = ["Python", "C++", "Jupyter Notebook", "TypeScript", "COBOL", "Go", "HTML"]


def pick(values: list, key: str):
    """The value at ``key`` modulo their number."""
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*map(lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick(values: list, key: str) -> str:
    return f"{values!r}[CAST({key} % {len(values)} + 1 AS INT)]"


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"position('{n}' IN {column}) > 0" for n in needles) + ")"


def _ladder(column: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, n)} THEN '{c}'" for c, n in rules) + f" ELSE {otherwise} END"


def _map(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


# --- career evidence


@query(f"""WITH t AS (SELECT c_custkey, {_pick(TITLES, "c_custkey")} AS title, CASE WHEN c_custkey % 5 = 0 THEN 'Senior' ELSE '' END AS level FROM customer), v AS (SELECT *, lower(level || ' ' || title) AS t FROM t)
 SELECT c_custkey, {_ladder("t", ev.SENIORITY, "'unknown'")} AS seniority, {_ladder("t", ev.CONTEXT, "CASE WHEN title = '' AND level = '' THEN 'unknown' ELSE 'individual_contributor' END")} AS context FROM v""")
def seniority_ladders(spark, d):
    level, title = F.when(F.col("c_custkey") % 5 == 0, "Senior"), pick(TITLES, "c_custkey")
    return table(spark, d, "customer").select("c_custkey", ev.seniority(level, title).alias("seniority"), ev.seniority_context(level, title).alias("context"))


@query(f"""WITH s AS (SELECT s_suppkey, {_pick(KINDS, "s_suppkey")} AS kind, {_pick(SIZES, "s_suppkey")} AS size, {_pick(INDUSTRIES, "s_suppkey")} AS industry FROM supplier),
 v AS (SELECT *, lower(kind || ' ' || size || ' ' || industry) AS t, lower(industry) AS i, replace(lower(size), ',', '') AS z, list_max(list_transform(list_filter(string_split_regex(translate(replace(lower(size), ',', ''), '+-', '  '), '\\s+'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS HUGEINT))) AS most FROM s)
 SELECT s_suppkey, {_ladder("t", ev.COMPANY, "'unknown'")} AS category, CASE WHEN i = '' THEN 'unknown' ELSE {_ladder("i", ev.INDUSTRY, "'other'")} END AS industry,
 CASE WHEN z LIKE '%self_employed%' OR trim(z) = '1' THEN 'solo' WHEN most IS NULL THEN 'unknown' WHEN most <= 200 THEN 'small' WHEN most <= 1000 THEN 'medium' WHEN most <= 5000 THEN 'large' ELSE 'enterprise' END AS size FROM v""")
def company_codes(spark, d):
    kind, size, industry = (pick(v, "s_suppkey") for v in (KINDS, SIZES, INDUSTRIES))
    return table(spark, d, "supplier").select("s_suppkey", ev.company_category(kind, size, industry).alias("category"), ev.industry_code(industry).alias("industry"), ev.organization_size(size).alias("size"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 END AS m, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS a, CASE WHEN o_orderkey % 4 > 0 THEN 1992 + o_orderkey % 9 END AS b FROM orders),
 w AS (SELECT o_orderkey, CASE WHEN m IS NOT NULL THEN m WHEN b >= a THEN (b - a) * 12 END AS n FROM v) SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 12 THEN 'under_one_year' WHEN n <= 36 THEN 'one_to_three_years' ELSE 'over_three_years' END AS band FROM w""")
def duration_bands(spark, d):
    key = F.col("o_orderkey")
    band = ev.duration_band(F.when(key % 3 == 0, key % 60), F.when(key % 7 > 0, F.year("o_orderdate")), F.when(key % 4 > 0, 1992 + key % 9))
    return table(spark, d, "orders").select("o_orderkey", band.alias("band"))


# --- project evidence


@query("WITH v AS (SELECT doc_id, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('t', n)} THEN '{c}' END" for c, n in sorted(ev.TECHNOLOGIES.items())) + f"], lambda x: x IS NOT NULL)[1:{ev.TECHNOLOGY_CODES}], ',') AS codes FROM v")
def technology_codes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(ev.technology_codes(F.col("text")), ",").alias("codes"))


@query(f"""WITH v AS (SELECT p_partkey, {_pick(TOPIC_LISTS, "p_partkey")} AS topics, lower({_pick(LANGUAGE_NAMES, "p_partkey")}) AS lang, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 END AS n, p_size % 2 = 0 AS pages FROM part)
 SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(topics, lambda x: {_map(ev.TOPICS, "lower(x)")}), lambda x: x IS NOT NULL))), ',') AS topics, coalesce({_map(ev.LANGUAGES, "lang")}, 'unknown') AS language,
 CASE WHEN n IS NULL THEN 'unknown' WHEN n > 0 THEN 'release_observed' ELSE 'none_observed' END AS release, CASE WHEN n > 0 THEN 'deployment_observed' WHEN pages THEN 'repository_homepage' WHEN n IS NULL THEN 'unknown' ELSE 'none_observed' END AS deployment FROM v""")
def repository_codes(spark, d):
    n = F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 3)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(ev.topic_codes(pick(TOPIC_LISTS, "p_partkey")), ",").alias("topics"), ev.language_code(pick(LANGUAGE_NAMES, "p_partkey")).alias("language"),
        ev.release_signal(n).alias("release"), ev.deployment_signal(n, F.lit(None).cast("string"), F.col("p_size") % 2 == 0).alias("deployment"),
    )


@query(f"""WITH r AS (SELECT *, o_orderkey % 5 = 0 OR o_orderstatus = 'P' OR o_orderkey % 11 = 0 AS other, {_pick(LANGUAGE_NAMES, "o_orderkey")} AS language FROM orders), w AS (SELECT *, {_map(ev.LANGUAGES, "lower(language)")} AS code FROM r)
 SELECT o_custkey, count(*) FILTER (NOT other) AS owned, CAST(coalesce(sum(o_orderkey % 100) FILTER (NOT other), 0) AS BIGINT) AS stars, CAST(coalesce(sum(o_orderkey % 13) FILTER (NOT other), 0) AS BIGINT) AS forks, count(*) FILTER (NOT other AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAYS) AS recent,
 coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (NOT other AND code IS NOT NULL)), ','), '') AS technologies FROM w GROUP BY 1""")
def repository_rollup(spark, d):
    key = F.col("o_orderkey")
    repos = table(spark, d, "orders").select(
        "o_custkey", (key % 5 == 0).alias("fork"), (F.col("o_orderstatus") == "P").alias("archived"), (key % 11 == 0).alias("disabled"), (key % 100).alias("stars"), (key % 13).alias("forks"),
        pick(LANGUAGE_NAMES, "o_orderkey").alias("language"), F.col("o_orderdate").alias("pushed_at"),
    )
    found = evidence.repository_rollup(repos, "o_custkey", F.lit("1998-01-01").cast("timestamp_ntz"))
    return found.withColumn("technologies", F.array_join("technologies", ","))


_PROJECT = ["product_maturity", "technical_depth", "execution_scope", "external_validation"]


@query(f"""WITH {FACTS}, p AS (SELECT id, {", ".join(f"CASE WHEN assessment_state = 'assessed' THEN {n} ELSE 'unknown' END AS {n}" for n in _PROJECT)}, CASE WHEN assessment_state = 'assessed' THEN originality ELSE 'unknown' END AS problem_differentiation FROM facts)
 SELECT id, CASE WHEN product_maturity IN ('production_evidence', 'working_product') AND technical_depth IN ('advanced', 'exceptional') AND execution_scope IN ('end_to_end_builder', 'primary_builder') AND external_validation IN ('meaningful', 'strong') AND problem_differentiation IN ('ambitious', 'differentiated') THEN 'standout'
 WHEN product_maturity IN ('production_evidence', 'working_product') AND technical_depth IN ('advanced', 'exceptional', 'moderate') AND execution_scope IN ('end_to_end_builder', 'primary_builder', 'substantial_contributor') THEN 'substantial'
 WHEN least({", ".join(f"CASE WHEN {n} IN ('unknown', 'none_observed') THEN 1 ELSE 0 END" for n in [*_PROJECT, "problem_differentiation"])}) = 0 THEN 'exploratory' ELSE 'insufficient' END AS tier FROM p""")
def builder_tiers(spark, d):
    known = lambda n: F.when(F.col("assessment_state") == "assessed", F.col(n)).otherwise("unknown")
    project = {n: known(n) for n in _PROJECT} | {"problem_differentiation": known("originality")}
    return views.facts(spark, d).select("id", ev.builder_tier(project).alias("tier"))


# --- claims and labels

_CELLS = " UNION ALL ".join(f"SELECT '{n}' AS dimension, CASE WHEN assessment_state = 'assessed' THEN {n} ELSE 'unknown' END AS cell, count(*) AS n FROM facts WHERE assessment_state <> 'excluded' GROUP BY ALL" for n in views.DIMENSIONS)


@query(f"WITH {FACTS}, c AS ({_CELLS}) SELECT dimension, CAST(sum(n) AS BIGINT) AS claims FROM c WHERE cell NOT IN ('unknown', 'none_observed') GROUP BY 1")
def positive_claims(spark, d):
    return evidence.positive_claims(aggregate.exclusive_counts(views.facts(spark, d), list(views.DIMENSIONS)), ["dimension"])


@query(f"WITH {FACTS}, c AS ({_CELLS}) SELECT dimension, CAST(sum(n) - sum(n) FILTER (cell = 'unknown') AS BIGINT) AS explicit_rule_match, CAST(sum(n) FILTER (cell = 'unknown') AS BIGINT) AS unknown FROM c GROUP BY 1")
def classification_confidence(spark, d):
    cells = aggregate.exclusive_counts(views.facts(spark, d), list(views.DIMENSIONS))
    totals = cells.groupBy("dimension").agg(F.sum("n").alias("denominator"))
    return evidence.confidence(cells.join(totals, "dimension"), "denominator")


CODES = ["data_ai", "go_to_market", "technical_depth", "founder", "web_full_stack"]


@query(f"WITH v AS (SELECT p_partkey, {_pick(CODES, 'p_partkey')} AS code FROM part) SELECT p_partkey, CASE code WHEN 'data_ai' THEN 'Data and AI' WHEN 'go_to_market' THEN 'Go-to-market' WHEN 'web_full_stack' THEN 'Full-stack web' WHEN 'founder' THEN 'Founder' ELSE 'Technical depth' END AS label FROM v")
def public_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", ev.public_label(pick(CODES, "p_partkey")).alias("label"))


# --- keyed codes, aliases, erased people

SECRETS = {"v1": b"fixture-secret-one", "v2": b"fixture-secret-two"}


def _hmac(secret: bytes, message: str) -> str:
    inner, outer = ("".join(f"\\x{b ^ p:02X}" for b in secret.ljust(64, b"\0")) for p in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({message}))))"


@query(f"SELECT c_custkey, 'person_' || {_hmac(SECRETS['v1'], 'c_name')}[1:24] AS code, 'case:v1:' || {_hmac(SECRETS['v1'], chr(39) + 'rich:' + chr(39) + ' || c_name')} AS ref FROM customer")
def keyed_codes(spark, d):
    padded = F.concat(F.lit(" "), "c_name", F.lit("\n"))
    return table(spark, d, "customer").select("c_custkey", ev.short_code("person", F.col("c_name"), SECRETS["v1"]).alias("code"), ev.case_reference(padded, SECRETS["v1"]).alias("ref"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 3 THEN o_orderkey + 7 END AS alias_person FROM orders")
def alias_join(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source_type"), F.col("o_orderkey").alias("external_id"))
    aliases = records.where("source_type = '1-URGENT' and external_id % 10 = 3").withColumn("person_id", F.col("external_id") + 7)
    return evidence.aliased(records, aliases).select(F.col("external_id").alias("o_orderkey"), "alias_person")


@query(f"""WITH e AS (SELECT c_custkey, lower(c_name || '@example.test') AS email FROM customer), k AS (SELECT c_custkey, {_hmac(SECRETS["v1"], "email")} AS a, {_hmac(SECRETS["v2"], "email")} AS b FROM e),
 g AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 2 = 0 THEN a ELSE b END AS token FROM k WHERE c_custkey % 7 = 0) SELECT c_custkey, min(person) AS ghost_person FROM k LEFT JOIN g ON token = a OR token = b GROUP BY 1""")
def ghost_block(spark, d):
    """Rows of erased people, whose tokens were made under two key versions."""
    rows = table(spark, d, "customer").select("c_custkey", text.email(F.concat("c_name", F.lit("@Example.Test"))).alias("email"))
    v1, v2 = (text.hmac_sha256(F.col("email"), SECRETS[v]) for v in ("v1", "v2"))
    even = F.col("c_custkey") % 2 == 0
    ghosts = rows.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("person_id"), F.when(even, "v1").otherwise("v2").alias("key_version"), F.when(even, v1).otherwise(v2).alias("identity_hmac"))
    return evidence.ghost_matches(rows, ghosts, F.col("email"), SECRETS).select("c_custkey", "ghost_person")


# --- scalar rules

STATUSES = [" Approved", "ACCEPTED", "declined ", "Rejected", "waitlist", "Waitlisted", "pending", ""]
TRUTHS = ["Yes", " true ", "1", "approved", "Checked In", "no", "", "0"]


@query(f"WITH v AS (SELECT o_orderkey, lower(trim({_pick(STATUSES, 'o_orderkey')})) AS s, lower(trim({_pick(TRUTHS, 'o_orderkey')})) AS t FROM orders) SELECT o_orderkey, CASE WHEN s IN ('approved', 'accepted') THEN 'accepted' WHEN s IN ('declined', 'rejected') THEN 'declined' WHEN s IN ('waitlist', 'waitlisted') THEN 'waitlist' ELSE 'applied' END AS status, t IN ('yes', 'true', '1', 'approved', 'checked in') AS truth FROM v")
def status_and_truth(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.status(pick(STATUSES, "o_orderkey")).alias("status"), text.truth(pick(TRUTHS, "o_orderkey")).alias("truth"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'user-' || c_custkey WHEN 1 THEN 'user-' || c_custkey WHEN 2 THEN 'user-' || c_custkey END AS github, CASE WHEN c_custkey % 3 < 2 THEN 'name-' || c_custkey END AS linkedin FROM customer""")
def profile_addresses(spark, d):
    user, c = F.concat(F.lit("User-"), F.col("c_custkey").cast("string")), F.col("c_custkey")
    github = F.when(c % 4 == 0, F.concat(F.lit(" @"), user)).when(c % 4 == 1, F.concat(F.lit("https://www.GitHub.com/"), user, F.lit("/repo?tab=1"))).when(c % 4 == 2, user).otherwise(F.concat(user, F.lit(" and more")))
    person = F.concat(F.lit("Name-"), c.cast("string"))
    linkedin = F.when(c % 3 == 0, F.concat(F.lit("https://uk.linkedin.com/in/"), person, F.lit("/"))).when(c % 3 == 1, F.concat(F.lit("linkedin.com/pub/in/"), person)).otherwise(F.concat(F.lit("https://example.test/in/"), person))
    return table(spark, d, "customer").select("c_custkey", text.github(github).alias("github"), text.linkedin(linkedin).alias("linkedin"))


@query("SELECT o_orderkey, (o_orderkey * 3 * 1250 + 999999) // 1000000 AS micros FROM orders")
def token_costs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.token_cost(F.col("o_orderkey") * 3, F.lit(1250)).alias("micros"))


@query("SELECT o_custkey, o_orderdate, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return contracts.duplicate_violations(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])
