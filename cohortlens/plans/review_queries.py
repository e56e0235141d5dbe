"""Named queries over review planning, payload walks, redaction and versioned stores, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import addresses, canonical, redaction
from cohortlens.operators import overlays, payloads, records, reviews
from cohortlens.operators.staging import new_path
from cohortlens.plans.evidence_queries import SECRETS, _hmac
from cohortlens.plans.queries import query
from cohortlens.plans.views import spread, table
from cohortlens.sources.versioned import VersionedTable
from cohortlens.streaming import vault

SECRET = SECRETS["v1"]


def _short(prefix: str, value: str) -> str:
    return f"'{prefix}_' || {_hmac(SECRET, value)}[1:24]"


def _digest(code: str) -> str:
    return f"CAST('0x' || substr(md5({code}), 1, 15) AS BIGINT)"


def _case(kind: str, reason: str, version: str) -> str:
    return f"""sha256(concat_ws(chr(10), '{kind}', subject_code, '{reason}', '{version}', 'h1', CAST(n_candidates AS VARCHAR), CAST(candidates_xor AS VARCHAR)))"""


@query(f"""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS external_id, 'u' || c_custkey || '@x.test' AS email, 'name ' || c_custkey % 300 AS name, {_digest(_short("person", "CAST(c_custkey AS VARCHAR)"))} AS digest FROM customer),
 m AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'submission' ELSE 'preference' END AS source_kind, CAST(o_orderkey AS VARCHAR) AS source_ref, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || o_custkey || '@x.test' END AS email, CASE WHEN o_orderkey % 7 > 0 THEN 'name ' || o_custkey % 500 ELSE '' END AS name FROM orders),
 c AS (SELECT m.source_kind, m.source_ref, any_value(e.external_id) AS external_id, {_short("member", "m.source_kind || ':' || m.source_ref")} AS subject_code, count(a.external_id) AS n_candidates, coalesce(bit_xor(a.digest), 0) AS candidates_xor
  FROM m LEFT JOIN a e ON e.email = m.email LEFT JOIN a ON a.name = m.name GROUP BY ALL),
 h AS (SELECT *, {_case("identity", "email_mismatch", "identity_rules_v1")} AS h FROM c)
 SELECT source_kind, source_ref, external_id, CASE WHEN external_id IS NULL THEN subject_code END AS subject_code, CASE WHEN external_id IS NULL THEN n_candidates END AS n_candidates, CASE WHEN external_id IS NULL THEN candidates_xor END AS candidates_xor,
 CASE WHEN external_id IS NULL THEN 'identity_' || h[1:16] END AS case_code, CASE WHEN external_id IS NULL THEN h END AS case_hash, CASE WHEN external_id IS NULL THEN 'email_mismatch' END AS reason FROM h""")
def review_people(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    mail = lambda k: F.concat(F.lit(" U"), F.col(k).cast("string"), F.lit("@X.test"))
    applications = c.select(F.col("c_custkey").cast("string").alias("external_id"), mail("c_custkey").alias("email"), F.concat(F.lit("Name-"), (F.col("c_custkey") % 300).cast("string")).alias("name"))
    members = o.select(
        F.when(F.col("o_orderstatus") == "F", "submission").otherwise("preference").alias("source_kind"), F.col("o_orderkey").cast("string").alias("source_ref"), F.when(F.col("o_orderkey") % 3 == 0, mail("o_custkey")).alias("email"),
        F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("NAME  "), (F.col("o_custkey") % 500).cast("string"))).alias("name"),
    )
    return reviews.people_plan(applications, members, SECRET, "h1")


def _teams(spark, d):
    number = lambda k, n: F.concat(F.lit("Team "), (F.col(k) % n).cast("string"))
    preferences = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_custkey").alias("team_id"), number("c_custkey", 700).alias("name"), F.col("c_mktsegment").alias("track"))
    segments = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
    return preferences, table(spark, d, "part").select(F.col("p_partkey").alias("project_id"), number("p_partkey", 900).alias("name"), F.element_at(segments, (F.col("p_partkey") % 7 % 5 + 1).cast("int")).alias("track"))


#: The plain greedy choice, team by team in each track.
_TEAMS = f"""p AS (SELECT p_partkey AS project_id, 'team ' || p_partkey % 900 AS name, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(p_partkey % 7 % 5 + 1 AS INT)] AS track, {_digest(_short("project", "CAST(p_partkey AS VARCHAR)"))} AS digest FROM part),
 t AS (SELECT c_custkey AS team_id, 'team ' || c_custkey % 700 AS name, c_mktsegment AS track, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
 own AS (SELECT team_id, t.track, i, coalesce(list(project_id) FILTER (project_id IS NOT NULL), []) AS same FROM t LEFT JOIN p ON p.name = t.name AND p.track = t.track GROUP BY ALL),
 g AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS before, CAST(NULL AS BIGINT) AS team_id, CAST(NULL AS BIGINT) AS project_id FROM t
  UNION ALL SELECT track, i, CASE WHEN len(free) = 1 THEN list_append(used, free[1]) ELSE used END, used, team_id, CASE WHEN len(free) = 1 THEN free[1] END
  FROM (SELECT o.track, o.i, g.used, o.team_id, list_filter(o.same, lambda x: NOT list_contains(g.used, x)) AS free FROM g JOIN own o ON o.track = g.track AND o.i = g.i + 1))"""


@query(f"""WITH RECURSIVE {_TEAMS},
 c AS (SELECT g.team_id, g.project_id, {_short("team", "CAST(g.team_id AS VARCHAR)")} AS subject_code, count(p.project_id) AS n_candidates, coalesce(bit_xor(p.digest), 0) AS candidates_xor
  FROM g LEFT JOIN p ON p.track = g.track AND NOT list_contains(g.before, p.project_id) WHERE g.team_id IS NOT NULL GROUP BY ALL), h AS (SELECT *, {_case("team", "ambiguous_match", "team_rules_v1")} AS h FROM c)
 SELECT team_id, project_id, CASE WHEN project_id IS NULL THEN subject_code END AS subject_code, CASE WHEN project_id IS NULL THEN n_candidates END AS n_candidates, CASE WHEN project_id IS NULL THEN candidates_xor END AS candidates_xor,
 CASE WHEN project_id IS NULL THEN 'team_' || h[1:16] END AS case_code, CASE WHEN project_id IS NULL THEN h END AS case_hash, CASE WHEN project_id IS NULL THEN 'ambiguous_match' END AS reason FROM h""")
def review_teams(spark, d):
    return reviews.team_plan(*_teams(spark, d), SECRET, "h1")


@query()
def unsafe_markers(spark, d):
    """The first direct identifier of each whole document. RE2 knows no look-around, so no SQL says this."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", redaction.marker_of("text").alias("marker"), redaction.without_legacy_of("text").alias("imported"))


_NAMES = ["colour", "ownership", "my-Phone", "size", "e_mail", "Source_Ref", "kind"]
_PAYLOAD = f"""'{{"part":{{"' || {_NAMES!r}[CAST(p_partkey % 7 + 1 AS INT)] || '":"' || p_name || '"}},"deep":' || repeat('[', CAST(p_partkey % 11 AS INT)) || '"' || p_type || CASE WHEN p_partkey % 13 = 0 THEN '@' ELSE '' END || '"'
 || repeat(']', CAST(p_partkey % 11 AS INT)) || ',"sizes":[' || repeat('1,', CAST(p_size * 3 AS INT)) || '2],"text":"' || repeat(p_name || ' ', CASE WHEN p_partkey % 19 = 0 THEN 2000 ELSE 1 END) || '"' || CASE WHEN p_partkey % 17 > 0 THEN '}}' ELSE '' END"""
_TREE = f"""p AS (SELECT p_partkey, {_PAYLOAD} AS payload FROM part),
 n AS (SELECT p_partkey, CASE WHEN t.id = 0 THEN NULL ELSE t.key END AS name, t.type AS kind, 'root' || replace(substr(t.fullkey, 2), '"', '') AS path, CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' END AS text,
  list_transform(string_split(replace(replace(substr(t.fullkey, 2), '"', ''), '[', '.['), '.')[2:], lambda x: CASE WHEN x[1] = '[' THEN lpad(x[2:-2], 10, '0') ELSE x END) AS place,
  CASE t.type WHEN 'ARRAY' THEN json_array_length(t.value) WHEN 'OBJECT' THEN len(json_keys(t.value)) END AS entries FROM p, json_tree(p.payload) t WHERE json_valid(p.payload))"""


def _walk(spark, d):
    key = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (key % 7 + 1).cast("int"))
    deep = lambda c: F.expr(f"repeat('{c}', cast(p_partkey % 11 as int))")
    payload = text(
        '{"part":{"', name, '":"', F.col("p_name"), '"},"deep":', deep("["), '"', F.col("p_type"), F.when(key % 13 == 0, "@").otherwise(""), '"', deep("]"), ',"sizes":[', F.expr("repeat('1,', cast(p_size * 3 as int))"),
        '2],"text":"', F.expr("repeat(concat(p_name, ' '), if(p_partkey % 19 = 0, 2000, 1))"), '"', F.when(key % 17 > 0, "}").otherwise(""),
    )
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"))  # payloads are hundreds of times as long as these
    return payloads.nodes(parts.select("p_partkey", payload.alias("payload")), "p_partkey", "payload")


@query(f"""WITH {_TREE},
 w AS (SELECT *, CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])({"|".join(payloads.FORBIDDEN)})') THEN 'forbidden_field' WHEN len(place) > 8 THEN 'too_deep' WHEN entries > 100 AND kind = 'OBJECT' THEN 'too_many_fields' WHEN entries > 100 THEN 'too_many_items' WHEN text LIKE '%@%' THEN 'at_sign' END AS problem FROM n),
 f AS (SELECT p_partkey, min({{'place': place, 'path': path, 'problem': problem}}) FILTER (problem IS NOT NULL) AS f, sum(coalesce(length(name), 0) + coalesce(length(text), 0)) AS chars FROM w GROUP BY 1)
 SELECT p_partkey, CASE WHEN NOT json_valid(payload) OR f.f IS NULL AND chars > 12000 THEN 'root' ELSE f.f.path END AS path, CASE WHEN NOT json_valid(payload) THEN 'unparsable' WHEN f.f IS NULL AND chars > 12000 THEN 'too_long' ELSE f.f.problem END AS problem FROM p LEFT JOIN f USING (p_partkey)""")
def payload_problems(spark, d):
    return payloads.first_problems(_walk(spark, d), lambda t: F.when(t.contains("@"), "at_sign")).withColumnRenamed("key", "p_partkey")


@query(f"""WITH {_TREE}, l AS (SELECT DISTINCT array_to_string(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')[1:2], ' ') AS form FROM part)
 SELECT DISTINCT p_partkey, form FROM n JOIN l ON position(' ' || form || ' ' IN ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ') > 0 WHERE length(replace(form, ' ', '')) >= 4 AND len(place) <= 9""")
def payload_literals(spark, d):
    """Which payloads hold the first two words of a part's name, anywhere."""
    texts = _walk(spark, d).where("text is not null").select(F.col("key").alias("p_partkey"), "text")
    literals = table(spark, d, "part").select(F.array_join(F.slice(records.identity_words(F.col("p_name")), 1, 2), " ").alias("literal"))
    return records.known_literals(texts, "p_partkey", "text", literals, "literal").distinct()


_LEVELS, _FACT_LEVELS = ["unknown", "senior", "junior", "founder"], ["senior", "Director", "mid", "other", "junior"]


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 OR c_custkey % 15 = 1 AS has, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS startup, {_LEVELS!r}[CAST(c_custkey % 4 + 1 AS INT)] AS known,
  CASE c_custkey % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'lead_staff_executive' WHEN 2 THEN 'mid_level' WHEN 4 THEN 'junior' END AS lvl, c_custkey % 2 = 1 AS engineer, c_custkey % 7 = 0 AS founder, c_custkey % 9 = 0 AS corrected,
  'evidence:career:' || sha256(CAST(c_custkey AS VARCHAR)) AS ref, c_mktsegment AS seg FROM customer),
 r AS (SELECT *, has AND (startup OR founder OR engineer OR lvl IS NOT NULL) AS changed, CASE WHEN corrected THEN 'junior' ELSE known END AS base_level FROM c),
 w AS (SELECT *, list_filter([CASE WHEN has AND lvl IS NOT NULL AND base_level <> 'unknown' AND base_level <> lvl THEN 'conflicting_evidence' END, CASE WHEN has AND founder THEN 'consequential_claim' END, CASE WHEN changed AND corrected THEN 'prior_human_correction' END], lambda x: x IS NOT NULL) AS reasons FROM r)
 SELECT CAST(k AS VARCHAR) AS subject_ref, array_to_string(list_sort(list_filter([CASE WHEN has AND startup THEN 'startup_operator' END, CASE WHEN has AND founder THEN 'founder_cofounder' END, CASE WHEN NOT (has AND (startup OR founder)) THEN 'unknown' END], lambda x: x IS NOT NULL)), ',') AS identity,
 CASE WHEN has AND founder THEN 'founder' WHEN has AND lvl IS NOT NULL THEN lvl WHEN changed THEN base_level ELSE known END AS seniority, CASE WHEN has AND engineer THEN 'engineering' ELSE 'unknown' END AS role, CASE WHEN has AND founder THEN 'founded_company' ELSE 'insufficient_evidence' END AS evidence,
 CASE WHEN has AND (founder OR lvl IS NOT NULL) THEN 0.8 ELSE 0.5 END AS confidence, CASE WHEN has AND (founder OR lvl IS NOT NULL) THEN ref END AS ref, array_to_string(reasons, ',') AS review_reasons, CASE WHEN len(reasons) > 0 THEN 'pending' ELSE 'resolved' END AS review_state,
 CASE WHEN has THEN sha256('{{"company_category":"' || CASE WHEN startup THEN 'Startup' ELSE 'public' END || '","founder_history":' || CASE WHEN founder THEN 'true' ELSE 'false' END || ',"seniority":"' || {_FACT_LEVELS!r}[CAST(k % 5 + 1 AS INT)] || '","title_category":"' || CASE WHEN engineer THEN 'software_engineering' ELSE 'other' END || '"}}') END AS fingerprint, 3 AS version FROM w""")
def overlay_merge(spark, d):
    """Facts of a third of the people, the same again, and those with some more: the second merge makes no version."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    one = lambda label, confidence=0.5: F.struct(F.array(F.lit(label) if isinstance(label, str) else label).alias("labels"), F.lit(confidence).alias("confidence"), F.array().cast("array<string>").alias("evidence_refs"), F.lit("unknown").alias("state"))
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (key % 4 + 1).cast("int"))
    dims = lambda seniority: F.create_map(F.lit("professional_identity"), one("unknown"), F.lit("functional_role"), one("unknown"), F.lit("builder_evidence"), one("insufficient_evidence"), F.lit("seniority"), one(seniority))
    base = c.select(key.cast("string").alias("subject_ref"), dims(level).alias("dimensions"), F.array().cast("array<string>").alias("review_reasons"), F.lit("resolved").alias("review_state"), F.lit(None).cast("string").alias("fingerprint"))
    corrections = c.where("c_custkey % 9 = 0").select(key.cast("string").alias("subject_ref"), dims("junior").alias("dimensions"))
    facts = c.select(
        key.cast("string").alias("subject_ref"), F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "Startup").otherwise("public").alias("company_category"), F.element_at(F.array(*map(F.lit, _FACT_LEVELS)), (key % 5 + 1).cast("int")).alias("seniority"),
        F.when(key % 2 == 1, "software_engineering").otherwise("other").alias("title_category"), (key % 7 == 0).alias("founder_history"), F.concat(F.lit("evidence:career:"), F.sha2(key.cast("string"), 256)).alias("evidence_ref"), "c_custkey",
    )
    store = VersionedTable(spark, new_path(spark, "classifications"), ["subject_ref"], 16)
    store.create(base)
    for batch in ("c_custkey % 3 = 0", "c_custkey % 3 = 0", "c_custkey % 3 = 0 or c_custkey % 15 = 1"):
        store.upsert(overlays.laid_over(store.read(), facts.where(batch).drop("c_custkey"), corrections), store.version())
    label = lambda name: F.array_join(F.col("dimensions")[name]["labels"], ",")
    s = F.col("dimensions")["seniority"]
    return store.read().select(
        "subject_ref", label("professional_identity").alias("identity"), label("seniority").alias("seniority"), label("functional_role").alias("role"), label("builder_evidence").alias("evidence"), s["confidence"].alias("confidence"),
        F.get(s["evidence_refs"], 0).alias("ref"), F.array_join("review_reasons", ",").alias("review_reasons"), "review_state", "fingerprint", F.lit(store.version()).alias("version"),
    )


@query("""WITH o AS (SELECT o_orderkey AS r, row_number() OVER (ORDER BY o_orderkey) AS id, count(*) OVER () AS last FROM orders), d AS (SELECT *, r % 6 AS m FROM o)
 SELECT r AS source_record_id, status, CASE status WHEN 'replayed' THEN id WHEN 'applied' THEN last + row_number() OVER (PARTITION BY status ORDER BY r) END AS decision_id FROM (SELECT *, CASE m WHEN 0 THEN 'replayed' WHEN 1 THEN 'applied' WHEN 2 THEN 'not_current' WHEN 3 THEN 'missing_person' WHEN 4 THEN 'person_given' ELSE 'invalid_decision' END AS status FROM d)""")
def decision_check(spark, d):
    """A decision on each order: the one that stands, one that supersedes it, and four that are wrong."""
    ids = table(spark, d, "orders").select("o_orderkey")
    log = reviews.running(ids, [], ["o_orderkey"], F.lit(1), "before").select(
        (F.col("before") + 1).alias("decision_id"), F.col("o_orderkey").alias("source_record_id"), (F.col("o_orderkey") % 90).alias("person_id"), F.lit("linked").alias("decision"), F.lit("ann").alias("reviewer"), F.lit("same e-mail").alias("reason"),
        F.lit("2026-01-01").alias("decided_at"), F.lit(None).cast("long").alias("supersedes"),
    )
    m = F.col("source_record_id") % 6
    new = log.select(
        F.col("source_record_id").alias("place"), "source_record_id", F.when(m != 3, F.col("person_id")).alias("person_id"), F.when(m == 4, "quarantined").when(m == 5, "perhaps").otherwise(F.col("decision")).alias("decision"), "reviewer",
        F.when(m == 0, F.col("reason")).otherwise("looked again").alias("reason"), "decided_at", F.when(m == 1, F.col("decision_id")).when(m == 2, F.col("decision_id") - 1).alias("supersedes"),
    )
    return reviews.checked_decisions(log, new).select("source_record_id", "status", "decision_id")


@query("""WITH r AS (SELECT sha256('{"application_id":"c\\u00e9-' || c_custkey % 1000 || '","event_key":"fixture-event"}') AS node, c_mktsegment AS track FROM customer), u AS (SELECT track, node, node || '*' || count(*) AS part FROM r GROUP BY track, node),
 c AS (SELECT track, count(*) AS n, CASE WHEN count(*) > 256 THEN 1 ELSE 0 END AS depth FROM u GROUP BY 1),
 a AS (SELECT u.track, n, node[1:depth] AS node, sha256(string_agg(part, ',' ORDER BY part)) AS digest, depth FROM u JOIN c USING (track) GROUP BY u.track, n, node[1:depth], depth),
 b AS (SELECT track, n, CASE WHEN max(depth) = 0 THEN max(digest) ELSE sha256(string_agg(node || ':' || digest, ',' ORDER BY node || ':' || digest)) END AS digest FROM a GROUP BY track, n)
 SELECT track, n AS applicants, digest FROM b""")
def population_hash(spark, d):
    """The digest of each track's applicants; identifiers hold a letter that JSON escapes."""
    people = table(spark, d, "customer").select(F.concat(F.lit("cé-"), (F.col("c_custkey") % 1000).cast("string")).alias("id"), F.col("c_mktsegment").alias("track"))
    rows = [(t, people.where(F.col("track") == t).select("id").distinct().count(), canonical.population_digest(people.where(F.col("track") == t), "id", "fixture-event")) for t in sorted(r[0] for r in people.select("track").distinct().collect())]  # five tracks
    return spark.createDataFrame(rows, "track string, applicants long, digest string")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey * 7919 % 4294967296 AS v4 FROM customer), o AS (SELECT k, [(k * 97) % 256, (k * 31) % 256, k % 256, (k * 7) % 256] AS p FROM c),
 n AS (SELECT k, p, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] AS v FROM o),
 h AS (SELECT k, v, array_to_string(p, '.') AS dotted, CASE WHEN k % 3 > 0 THEN NULL WHEN k % 4 = 0 THEN 'fe80' WHEN k % 4 = 1 THEN '2606' WHEN k % 4 = 2 THEN '2001' ELSE 'fd12' END AS first, lower(hex(k % 65536)) AS low FROM n)
 SELECT k AS c_custkey, CASE WHEN first IS NULL THEN dotted ELSE first || ':' || lower(hex(k % 1024)) || '::' || low END AS address,
 CASE WHEN first IN ('fe80', 'fd12') THEN 'not_public' WHEN first = '2606' THEN NULL WHEN first = '2001' THEN CASE WHEN k % 1024 IN (3) OR k % 1024 BETWEEN 32 AND 63 OR k % 1024 = 1 AND k % 65536 IN (1, 2) THEN 'public' WHEN k % 1024 < 512 THEN 'not_public' END
  WHEN v IN (3221225481, 3221225482) THEN 'public' WHEN v < 16777216 OR v BETWEEN 167772160 AND 184549375 OR v BETWEEN 1681915904 AND 1686110207 OR v BETWEEN 2130706432 AND 2147483647 OR v BETWEEN 2851995648 AND 2852061183 OR v BETWEEN 2886729728 AND 2887778303
   OR v BETWEEN 3221225472 AND 3221225727 OR v BETWEEN 3221225984 AND 3221226239 OR v BETWEEN 3232235520 AND 3232301055 OR v BETWEEN 3323068416 AND 3323199487 OR v BETWEEN 3325256704 AND 3325256959 OR v BETWEEN 3405803776 AND 3405804031 OR v >= 4026531840 THEN 'not_public' END AS kind FROM h""")
def address_blocks(spark, d):
    """Addresses of both versions and the block that each is in; the SQL compares numbers with the ends of the blocks."""
    k = F.col("c_custkey")
    dotted = F.concat_ws(".", *[(x % 256).cast("string") for x in (k * 97, k * 31, k, k * 7)])
    first = F.when(k % 4 == 0, "fe80").when(k % 4 == 1, "2606").when(k % 4 == 2, "2001").otherwise("fd12")
    address = F.when(k % 3 > 0, dotted).otherwise(F.concat(first, F.lit(":"), F.lower(F.hex(k % 1024)), F.lit("::"), F.lower(F.hex(k % 65536))))
    rows = table(spark, d, "customer").select("c_custkey", address.alias("address")).withColumn("bits", addresses.address_bits(F.col("address")))
    return addresses.located(rows, "bits", addresses.blocks(spark)).drop("bits")


@query("""WITH u AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'http://' WHEN 1 THEN 'HTTPS://u:p@' ELSE 'https://' END || CASE c_custkey % 7 WHEN 0 THEN 'Page-' || c_custkey || '.Test' WHEN 1 THEN 'localhost' WHEN 2 THEN '10.0.0.' || c_custkey % 256 WHEN 3 THEN 'a%2eb' ELSE 'p' || c_custkey || '.test.' END
  || CASE c_custkey % 5 WHEN 0 THEN ':443' WHEN 1 THEN ':80' ELSE '' END || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/x?y=1' WHEN 2 THEN '/z' ELSE '?q' END || CASE c_custkey % 11 WHEN 0 THEN '#top' ELSE '' END AS url FROM customer),
 p AS (SELECT *, CASE WHEN c_custkey % 7 = 3 THEN 'percent_host' WHEN c_custkey % 9 = 0 THEN 'not_https' WHEN c_custkey % 9 = 1 THEN 'credentials' WHEN c_custkey % 11 = 0 THEN 'fragment' WHEN c_custkey % 5 = 1 THEN 'port' WHEN c_custkey % 7 = 1 THEN 'local' WHEN c_custkey % 7 = 2 THEN 'numeric_host' END AS problem FROM u)
 SELECT c_custkey, url, problem, CASE WHEN problem IS NULL THEN 'https://' || CASE c_custkey % 7 WHEN 0 THEN 'page-' || c_custkey || '.test' ELSE 'p' || c_custkey || '.test' END || CASE c_custkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '/x?y=1' WHEN 2 THEN '/z' ELSE '/?q' END END AS canonical FROM p""")
def page_addresses(spark, d):
    k = F.col("c_custkey")
    name = k.cast("string")
    host = F.when(k % 7 == 0, F.concat(F.lit("Page-"), name, F.lit(".Test"))).when(k % 7 == 1, "localhost").when(k % 7 == 2, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).when(k % 7 == 3, "a%2eb").otherwise(F.concat(F.lit("p"), name, F.lit(".test.")))
    url = F.concat(
        F.when(k % 9 == 0, "http://").when(k % 9 == 1, "HTTPS://u:p@").otherwise("https://"), host, F.when(k % 5 == 0, ":443").when(k % 5 == 1, ":80").otherwise(""),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "/x?y=1").when(k % 4 == 2, "/z").otherwise("?q"), F.when(k % 11 == 0, "#top").otherwise(""),
    )
    found = addresses.checked_pages(table(spark, d, "customer").select("c_custkey", url.alias("url")), "url")
    return found.select("c_custkey", "url", "page.problem", F.col("page.url").alias("canonical"))


@query("""WITH RECURSIVE q AS (SELECT 'u' || user_id % 300 || '-' || event_id % 3 AS ref, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'capture' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'delete' ELSE 'look' END AS action,
   CASE WHEN event_id % 10 = 0 THEN 'q' ELSE 'p' END AS subject, sha256(coalesce(props, '')) AS d, octet_length(encode(coalesce(props, ''))) AS n, CAST(floor(value * 1000) AS BIGINT) AS ttl, event_id % 3 = 0 AS reviewed FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ts, seq) AS i FROM q),
 f AS (SELECT DISTINCT ref, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS digest, CAST(NULL AS BIGINT) AS n_bytes, CAST(NULL AS VARCHAR) AS owner,
   CAST(NULL AS TIMESTAMP) AS ends, FALSE AS live, FALSE AS gone, CAST(NULL AS TIMESTAMP) AS over_at, CAST(NULL AS VARCHAR) AS over_digest FROM r
  UNION ALL SELECT ref, i, ts, seq, action, outcome, CASE outcome WHEN 'captured' THEN d ELSE digest END, CASE outcome WHEN 'captured' THEN n ELSE n_bytes END, CASE outcome WHEN 'captured' THEN subject ELSE owner END, CASE outcome WHEN 'captured' THEN ts + to_seconds(ttl) ELSE ends END,
   outcome = 'captured' OR live AND outcome <> 'deleted', gone OR outcome = 'deleted', over_at, CASE WHEN over_at IS NOT NULL THEN digest END
  FROM (SELECT *, CASE action WHEN 'look' THEN 'invalid' WHEN 'capture' THEN CASE WHEN n = 0 OR ttl <= 0 OR ttl > 86400 THEN 'invalid' WHEN gone THEN 'gone' WHEN live THEN CASE WHEN d = digest AND subject = owner THEN 'replayed' ELSE 'changed' END ELSE 'captured' END
    ELSE CASE WHEN NOT live THEN CASE WHEN gone THEN 'gone' ELSE 'unknown' END WHEN action = 'read' THEN CASE WHEN subject = owner THEN 'read' ELSE 'refused' END WHEN reviewed THEN 'deleted' ELSE 'invalid' END END AS outcome
   FROM (SELECT f.ref, r.i, r.ts, r.seq, r.action, r.subject, r.d, r.n, r.ttl, r.reviewed, f.digest, f.n_bytes, f.owner, f.ends, f.live AND r.ts < f.ends AS live, f.gone OR f.live AND r.ts >= f.ends AS gone, CASE WHEN f.live AND r.ts >= f.ends THEN f.ends END AS over_at
    FROM f JOIN r ON r.ref = f.ref AND r.i = f.i + 1))),
 at_end AS (SELECT ref, arg_max(live, i) AS live, arg_max(ends, i) AS ends, arg_max(digest, i) AS digest, arg_max(n_bytes, i) AS n_bytes FROM f GROUP BY 1)
 SELECT ref, ts, seq, action, outcome, digest, n_bytes FROM f WHERE i > 0 UNION ALL SELECT ref, over_at, NULL, 'expire', 'expired', over_digest, n_bytes FROM f WHERE over_at IS NOT NULL
 UNION ALL SELECT ref, ends, NULL, 'expire', 'expired', digest, n_bytes FROM at_end WHERE live AND ends <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def vault_receipts(spark, d):
    """The events as requests to a vault: played as a stream to its end, timers included."""
    path = f"{d}/events.parquet"
    # A pattern may name a file; a plain path must be a folder.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    kind = F.col("event_type")
    action = F.when(kind == "view", "capture").when(kind.isin("click", "purchase"), "read").when(kind == "error", "delete").otherwise("look")
    requests = stream.select(
        F.concat(F.lit("u"), (F.col("user_id") % 300).cast("string"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("ref"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("s").alias("source"),
        F.when(F.col("event_id") % 10 == 0, "q").otherwise("p").alias("subject"), F.coalesce("props", F.lit("")).cast("binary").alias("payload"), F.floor(F.col("value") * 1000).alias("ttl"), F.when(F.col("event_id") % 3 == 0, "reviewed").otherwise("none").alias("reason"),
    )
    out = new_path(spark, "receipts")
    vault.receipts(requests).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(vault.RECEIPT).parquet(out).select("ref", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "action", "outcome", "digest", "n_bytes")
