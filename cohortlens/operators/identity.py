"""The identity ladder: which person each record belongs to, settled in rounds over (record, identifier) edges.

Records come in an order (place, record) and each sees the accepted ones before it. An e-mail, and a profile that the applicant gave
on both sides, are strong identifiers; so is a reviewed alias of the record. A record whose strong identifiers belong to

* several persons is ``quarantined`` and leaves nothing behind,
* one person is ``merged`` into it, and its identifiers become that person's,
* nobody is a person of its own: under ``review`` where a profile given on one side only, or the same name together with the
  same team or affiliation, points to a person, else ``new``.

An identifier belongs to the person of the first accepted record that holds it, so it has one owner at most. In a round,
a record is settled if each of its identifiers has an owner or is held by no earlier open record, and also if two owners
are known already, as more can't mend that. So a round settles all that wait for no one: an identifier that a third of
all records share holds these up for one round, not for one each. Rounds number the longest chain of records of which each waits for the one
before; there is no limit to them. Edges and owners are joined by identifier and aggregated by record: no group is
gathered, and a hot identifier is a skewed join, which Spark splits. Each round is written to the shared folder.

Defined results: a record without identifiers is new; null, empty or white-space values are none; repeated record
numbers are an error of the caller (``duplicates`` tells them); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.staging import new_path, running, stored

PROFILES = ("github", "linkedin")


def duplicates(records: DataFrame) -> DataFrame:
    """Record numbers that occur more than once."""
    return records.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strong_edges(records: DataFrame) -> DataFrame:
    """``(at, record, type, value)`` of e-mails and profiles that the applicant gave."""
    keys = [F.struct(F.lit("email").alias("type"), _given(F.col("email")).alias("value"))]
    keys += [F.struct(F.lit(p).alias("type"), F.when(F.array_contains("provided", p), _given(F.col(p))).alias("value")) for p in PROFILES]
    return records.select("at", "record", F.explode(F.array(*keys)).alias("k")).select("at", "record", "k.type", "k.value").where("value is not null")


def _weak_keys() -> Column:
    """What a name says together with a team or an affiliation, and profiles whoever gave them."""
    name = _given(F.lower("name"))
    keys = [F.struct(F.lit(c).alias("type"), F.when(name.isNotNull() & _given(F.col(c)).isNotNull(), F.concat(name, F.lit("\0"), _given(F.lower(c)))).alias("value")) for c in ("team", "affiliation")]
    keys += [F.struct(F.lit(p).alias("type"), _given(F.col(p)).alias("value")) for p in PROFILES]
    return F.explode(F.filter(F.array(*keys), lambda k: k["value"].isNotNull()))


def settled(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``(record, person, by)`` of all records with edges; person is null where quarantined, ``by`` the types that led to it.

    ``owners``: type, value, person of identifiers that are owned from the start.
    """
    spark, base, rounds = edges.sparkSession, new_path(edges.sparkSession, "settled"), 0
    edges, owners = stored(edges, "edges"), stored(owners.select("type", "value", "person"), "owners")
    while True:
        first = edges.groupBy("type", "value").agg(F.min("at").alias("first"))
        known = edges.join(first, ["type", "value"]).join(owners, ["type", "value"], "left")
        waits = F.col("person").isNull() & (F.col("first") < F.col("at"))
        ready = known.groupBy("record").agg(
            F.min("person").alias("person"), F.max("person").alias("other"), F.bool_or(waits).alias("waits"), F.sort_array(F.collect_set(F.when(F.col("person").isNotNull(), F.col("type")))).alias("by"),
        ).where("not waits or person < other")
        decided = F.when(F.col("person").isNull(), F.col("record")).when(F.col("person") == F.col("other"), F.col("person"))
        ready = stored(ready.select("record", decided.alias("person"), "by"), "settled", f"{base}/round={rounds}")
        rounds += 1
        newly = edges.join(ready.where("person is not null"), "record").select("type", "value", "person").join(owners.select("type", "value"), ["type", "value"], "left_anti").distinct()
        left = stored(edges.join(ready.select("record"), "record", "left_anti"), "edges")
        if left.isEmpty():
            return spark.read.schema(ready.schema).parquet(f"{base}/round=*")
        # Owners of what no open record holds are looked up no more.
        owners = stored(owners.unionByName(newly).join(left.select("type", "value").distinct(), ["type", "value"], "left_semi"), "owners")
        edges = left


def resolve(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """record, person, outcome, reason and suggested (the smallest person that weak evidence names).

    ``records``: record (its number is that of the person it begins), place, email, github, linkedin, provided (the profile kinds
    that the applicant gave), name, team, affiliation; values normalised. ``aliases``: record, person.
    """
    records = stored(records.withColumn("at", F.struct("place", "record")), "records")
    edges = strong_edges(records)
    owners = edges.select("type", "value", F.col("record").alias("person")).limit(0)
    if aliases is not None:
        named = aliases.select(F.lit("alias").alias("type"), F.col("record").cast("string").alias("value"), "person")
        edges = edges.unionByName(records.join(aliases.select("record"), "record", "left_semi").select("at", "record", F.lit("alias").alias("type"), F.col("record").cast("string").alias("value")))
        owners = owners.unionByName(named)
    found = settled(edges, owners)
    whole = records.join(found, "record", "left").withColumn("lone", F.col("by").isNull() | (F.size("by") == 0))
    whole = whole.withColumn("person", F.when(F.col("by").isNull(), F.col("record")).otherwise(F.col("person")))
    whole = stored(whole, "placed")

    accepted = whole.where("person is not null")
    mails = accepted.where(_given(F.col("email")).isNotNull()).groupBy("person").agg(F.min("at").alias("first_mail"))
    # Persons are suggested in the order in which they began; those that aliases alone name come before all.
    began = records.select(F.col("record").alias("person"), F.col("at").alias("began"))
    weak = accepted.join(began, "person", "left").select("place", "record", "lone", F.coalesce("began", F.struct(F.lit(None).cast(records.schema["place"].dataType).alias("place"), F.col("person").alias("record"))).alias("began"), _weak_keys().alias("k"))
    weak = running(weak.select("place", "record", "lone", "began", "k.type", "k.value"), ["type", "value"], ["place", "record"], F.col("began"), "holder", "min")
    hints = weak.where("lone and holder is not null").groupBy("record").agg(F.min("holder")["record"].alias("suggested"), F.bool_or(F.col("type").isin(*PROFILES)).alias("profile"))

    out = whole.join(hints, "record", "left").join(mails, "person", "left")
    by_profile = F.arrays_overlap("by", F.array(*map(F.lit, PROFILES)))
    mismatch = _given(F.col("email")).isNotNull() & ~F.array_contains("by", "email") & (F.col("first_mail") < F.col("at"))
    reason = (
        F.when(F.col("person").isNull(), "STRONG_IDENTIFIER_CONFLICT")
        .when(F.col("lone"), F.when(F.col("profile"), "PROFILE_EVIDENCE_NOT_BILATERAL").when(F.col("suggested").isNotNull(), "WEAK_NAME_CONTEXT_MATCH").otherwise("NO_STRONG_MATCH"))
        .when(F.array_contains("by", "alias"), "EXPLICIT_SOURCE_RECORD_ALIAS")
        .when(by_profile, F.when(mismatch, "BILATERAL_APPLICANT_PROFILE_EMAIL_MISMATCH").otherwise("BILATERAL_APPLICANT_PROFILE")).otherwise("EXACT_EMAIL")
    )
    outcome = F.when(F.col("person").isNull(), "quarantined").when(~F.col("lone"), "merged").when(F.col("suggested").isNotNull(), "review").otherwise("new")
    return out.select("record", "person", outcome.alias("outcome"), reason.alias("reason"), "suggested")
