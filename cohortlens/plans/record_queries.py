"""Named queries over records, reviews and ledgers, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import records
from cohortlens.plans.evidence_queries import SECRETS, _hmac
from cohortlens.plans.queries import query
from cohortlens.plans.views import table


@query("""WITH p AS (SELECT p_partkey, p_name || '@a.test; ' || p_brand || '@b.test' || CASE WHEN p_partkey % 3 = 0 THEN ',| x@c.test' ELSE '' END AS emails, p_name AS first FROM part),
 e AS (SELECT p_partkey, first, unnest(list_filter(list_transform(string_split_regex(emails, '[\n,;|]+'), lambda x: trim(x)), lambda x: x <> '')) AS email, generate_subscripts(list_filter(list_transform(string_split_regex(emails, '[\n,;|]+'), lambda x: trim(x)), lambda x: x <> ''), 1) AS i FROM p)
 SELECT p_partkey, i AS ordinal, email, CASE WHEN i = 1 THEN first ELSE 'Member ' || i END AS name FROM e""")
def preference_people(spark, d):
    third = F.when(F.col("p_partkey") % 3 == 0, ",| x@c.test").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("@a.test; "), "p_brand", F.lit("@b.test"), third).alias("emails"), "p_name")
    return records.preference_people(rows, "emails", "p_name")


@query("""SELECT c_custkey, 1 AS ordinal, 'a@x.test' AS email, c_name || ' ' || c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'b' || c_custkey || '@x.test', CASE WHEN c_custkey % 3 = 0 THEN 'Member 2' ELSE c_name END FROM customer""")
def project_people(spark, d):
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("f1"), F.concat(F.lit(" "), "c_mktsegment").alias("l1"), F.when(key % 2 == 0, "a@x.test ").otherwise(" ").alias("e1"),
        F.when(key % 3 != 0, F.col("c_name")).alias("f2"), F.lit("").alias("l2"), F.concat(F.lit("b"), key.cast("string"), F.lit("@x.test")).alias("e2"),
    )
    return records.project_people(rows, [("f1", "l1", "e1"), ("f2", "l2", "e2")])


@query("""WITH c AS (SELECT 'n' || c_nationkey AS field, c_nationkey % 7 AS k, count(*) AS value FROM customer GROUP BY ALL) SELECT field, CASE k WHEN 1 THEN value + 1 ELSE value END AS value, CASE k WHEN 2 THEN 'event' WHEN 3 THEN 'drift' WHEN 4 THEN 'value' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'duplicate' END AS problem FROM c
 UNION ALL SELECT field, value, 'duplicate' FROM c WHERE k = 6 UNION ALL SELECT 'nowhere', NULL, 'unknown'""")
def attendance_override(spark, d):
    """Corrections of counts, most of which have something wrong."""
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("field"), (F.col("c_nationkey") % 7).alias("k")).agg(F.count(F.lit(1)).alias("value"))
    k = F.col("k")
    log = c.where("k > 0").select(
        "field", F.concat(F.lit("event:"), F.when(k == 2, "e2").otherwise("e1"), F.lit(":"), "field").alias("stable_key"), (F.col("value") + F.when(k == 3, 1).otherwise(0)).alias("source_value"),
        F.when(k == 4, -1).otherwise(F.col("value") + 1).cast("long").alias("corrected_value"), F.when(k == 5, " ").otherwise("counted again").alias("reason"), F.lit("note").alias("evidence_note"), "k",
    )
    stray = spark.range(1).selectExpr("'nowhere' AS field", "'event:e1:nowhere' AS stable_key", "1L AS source_value", "2L AS corrected_value", "'r' AS reason", "'e' AS evidence_note")
    log = log.unionByName(log.where("k = 6")).drop("k").unionByName(stray)
    return records.overridden(c.select("field", "value"), log, "e1")


@query(f"""WITH a AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS accepted, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS came FROM orders GROUP BY 1)
 SELECT c_name AS external_id, 'p-' || c_custkey AS profile, 'source:application:' || {_hmac(SECRETS["v1"], "c_name")}[1:24] AS source_record_ref, CASE WHEN came THEN 'checked_in' WHEN accepted THEN 'accepted_not_checked_in' ELSE 'other' END AS priority FROM customer LEFT JOIN a ON o_custkey = c_custkey WHERE c_custkey % 4 > 0""")
def evaluation_candidates(spark, d):
    url = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("https://linkedin.com/in/p-"), F.col("c_custkey").cast("string"))).otherwise("https://linkedin.com/company/x")
    applications = table(spark, d, "customer").select(F.col("c_name").alias("external_id"), F.col("c_custkey").alias("email"), url.alias("linkedin"))
    f = F.col("o_orderstatus") == "F"
    attendance = table(spark, d, "orders").select(F.col("o_custkey").alias("email"), f.alias("accepted"), (f & (F.col("o_orderpriority") == "1-URGENT")).alias("checked_in"))
    return records.evaluation_candidates(applications, attendance, SECRETS["v1"])


@query("""SELECT o_orderkey AS source_ref, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS person, CASE WHEN o_orderkey % 5 > 0 THEN 'exact' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'unresolved' END AS link FROM orders""")
def resolved_links(spark, d):
    o = table(spark, d, "orders").withColumn("source_ref", F.col("o_orderkey"))
    action = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "P", "reject")
    decisions = o.where("o_orderkey % 5 = 0").select("source_ref", action.alias("action"), (F.col("o_custkey") + 1).alias("person"))
    return records.resolved_links(o.select("source_ref", F.col("o_custkey").alias("person")), decisions)


@query("SELECT o_orderkey AS case_code, CAST(o_custkey AS VARCHAR) AS case_hash, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 = 0 THEN o_orderstatus END AS decision FROM orders")
def review_refresh(spark, d):
    """Of each fourth case a decision is known; each third case has changed since."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_code"), F.col("o_custkey").cast("string").alias("case_hash"), "o_orderstatus")
    old = o.where("case_code % 4 = 0").select("case_code", F.when(F.col("case_code") % 3 == 0, "old").otherwise(F.col("case_hash")).alias("case_hash"), F.col("o_orderstatus").alias("decision"))
    return records.refreshed(o.drop("o_orderstatus"), old)


@query("""WITH b AS (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'high' WHEN o_orderkey % 11 = 0 THEN 'notable' ELSE 'some' END AS band FROM orders)
 SELECT o_custkey, CASE WHEN count(*) FILTER (band = 'high') > 0 OR count(*) FILTER (band = 'notable') > 1 THEN 'strong' WHEN count(*) FILTER (band = 'notable') = 1 THEN 'meaningful' ELSE 'none' END AS support FROM b GROUP BY 1""")
def validation_support(spark, d):
    band = F.when(F.col("o_orderkey") % 97 == 0, "high").when(F.col("o_orderkey") % 11 == 0, "notable").otherwise("some")
    bands = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(band).alias("bands"))
    return bands.select("o_custkey", records.validation_support(F.col("bands")).alias("support"))


@query("SELECT p_partkey, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO') THEN 'occupation' WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'signal' WHEN p_size > 40 THEN 'fact' WHEN p_partkey % 4 = 0 THEN 'confidence' END AS problem FROM part")
def classification_contract(spark, d):
    c = F.col
    fact, sure = F.when(c("p_size") > 40, F.repeat(F.lit("x"), 501)), F.when(c("p_partkey") % 4 > 0, c("p_size") / 50)
    return table(spark, d, "part").select("p_partkey", records.classification_problem(c("p_type"), c("p_brand"), fact, sure, ["ECONOMY", "SMALL", "PROMO"], ["Brand#1", "Brand#2", "Brand#3"]).alias("problem"))


@query("""WITH c AS (SELECT c_nationkey AS nation, unnest([1, 2, 3]) AS t, c_custkey AS k FROM customer), m AS (SELECT nation, k, (k + t) % 3 = 0 OR t = 1 AS e, (k + t) % 4 = 0 OR t = 2 AS p FROM c),
 s AS (SELECT nation, count(*) FILTER (e AND p) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(DISTINCT k) FILTER (e <> p) AS error_cases FROM m GROUP BY 1)
 SELECT *, CASE WHEN tp + fp = 0 THEN 10000 ELSE tp * 10000 // (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 10000 ELSE tp * 10000 // (tp + fn) END AS recall FROM s""")
def claim_scores(spark, d):
    k = F.col("c_custkey")
    claims = lambda n, always: F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda t: ((k + t) % n == 0) | (t == always))
    cases = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), claims(3, 1).alias("e"), claims(4, 2).alias("p"))
    return records.claim_scores(cases, "e", "p", ["nation"])


@query("""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark), l AS (SELECT DISTINCT array_to_string(w[1:3 + CAST(item_id % 3 AS INT)], ' ') AS form FROM w),
 t AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS words FROM documents) SELECT doc_id, form FROM t JOIN l ON position(' ' || form || ' ' IN words) > 0 WHERE length(replace(form, ' ', '')) >= 4""")
def known_literals(spark, d):
    """Which documents hold the first three to five words of a benchmark item."""
    words = records.identity_words(F.col("text"))
    literals = table(spark, d, "benchmark").select(F.array_join(F.slice(words, 1, (3 + F.col("item_id") % 3).cast("int")), " ").alias("literal"))
    return records.known_literals(table(spark, d, "documents"), "doc_id", "text", literals, "literal")


@query("""WITH a AS (SELECT o_orderkey, 'u' || o_custkey || '@x.test' AS email FROM orders), x AS (SELECT 'u' || c_custkey || '@x.test' AS email FROM customer WHERE c_custkey % 50 = 0 UNION SELECT 'nobody@x.test')
 SELECT o_orderkey, email, 'match' AS part FROM a WHERE email IN (SELECT email FROM x) UNION ALL SELECT NULL, email, 'unlinked' FROM x WHERE email NOT IN (SELECT email FROM a)""")
def excluded_attendance(spark, d):
    name = lambda key: F.concat(F.lit("u"), F.col(key).cast("string"), F.lit("@x.test"))
    excluded = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.upper(name("c_custkey")).alias("email")).unionByName(spark.range(1).select(F.lit(" nobody@X.test").alias("email")))
    matches, unlinked = records.excluded_attendance(table(spark, d, "orders").select("o_orderkey", name("o_custkey").alias("email")), excluded)
    return matches.withColumn("part", F.lit("match")).unionByName(unlinked.select(F.lit(None).cast("long").alias("o_orderkey"), "email", F.lit("unlinked").alias("part")))


@query("""SELECT o_orderkey, 'orders:' || sha256('{"inputs":{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '},"version":"v1"}') AS cache_key,
 CASE WHEN o_orderkey % 2 = 0 AND o_orderdate > TIMESTAMP '1996-01-01' THEN o_orderpriority END AS payload FROM orders""")
def cache_lookup(spark, d):
    """Each second order is in the cache; a status is null."""
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    cache = o.where("o_orderkey % 2 = 0").select(records.cache_key("orders", "v1", ["o_orderkey", "status"]).alias("cache_key"), F.col("o_orderpriority").alias("payload"), F.col("o_orderdate").alias("expires_at"))
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    kept, _ = records.without_expired(cache, now)
    return records.cached(o.select("o_orderkey", "status"), kept, "orders", "v1", ["status", "o_orderkey"], now).select("o_orderkey", "cache_key", "payload")


@query("""WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'reserved' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state, CAST(floor(value * 100) AS BIGINT) AS cost FROM events)
 SELECT user_id, arg_max(state, event_id) AS state, count(*) FILTER (state = 'reserved') AS attempts, CAST(sum(cost) AS BIGINT) AS cost FROM l GROUP BY 1""")
def run_ledger(spark, d):
    kind = F.col("event_type")
    state = F.when(kind.isin("view", "click"), "reserved").when(kind == "error", "failed").otherwise("completed")
    return records.ledger(table(spark, d, "events").select("user_id", "event_id", state.alias("state"), F.floor(F.col("value") * 100).alias("cost")), "user_id", "event_id")


@query("""WITH a AS (SELECT replace(o_orderpriority, '1-URGENT', 'top') AS key, count(*) AS value FROM orders GROUP BY 1), b AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'top' ELSE o_orderpriority END AS key, count(*) FILTER (o_orderpriority <> '2-HIGH' OR o_orderstatus <> 'P') AS value FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
 SELECT key, a.value AS left_value, b.value AS right_value FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value""")
def contract_parity(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "key")
    left = o.groupBy("key").agg(F.count(F.lit(1)).alias("value"))
    counted = (F.col("key") != "2-HIGH") | (F.col("o_orderstatus") != "P")
    right = o.where("key <> '5-LOW'").groupBy(F.when(F.col("key") == "1-URGENT", "top").otherwise(F.col("key")).alias("key")).agg(F.count_if(counted).alias("value"))
    return records.parity(left, right, {"1-URGENT": "top"})


@query("SELECT n_name AS role, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'available' WHEN n_regionkey = 0 THEN 'unavailable' ELSE 'missing_optional' END AS state, CASE WHEN n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AND n_regionkey = 0 THEN 'required_source' END AS problem FROM nation")
def source_notes(spark, d):
    nations = table(spark, d, "nation")
    there = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey").select(F.col("n_name").alias("role"))
    return records.source_notes(nations.select(F.col("n_name").alias("role"), (F.col("n_regionkey") == 0).alias("required")), there)
