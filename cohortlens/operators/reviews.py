"""Planning of reviews: which people and teams are linked by themselves, and what is left for a reviewer.

People: a member record is linked to the application of the same e-mail; any other becomes an identity case whose candidates
are the applications of the same normalised name.

Teams, in the order of their preferences: a team takes the one unused project of its normalised name and track, if there is exactly one;
any other becomes a team case whose candidates are the projects of its track that no team before it has taken. A project can be taken only
where it is the sole one of its name and track, and then the first team of that name and track takes it; so the greedy
choice is one minimum for each name and track. What was taken before a case is a running total over the track.

A case holds the number of its candidates and the xor of their digests, from which its code follows: a case changes with its
candidates. The candidates themselves are looked up for the cases that a reviewer opens (``identity_candidates``,
``team_candidates``), as a hot name or track would otherwise give each of its cases the whole of it. No group is gathered:
names and tracks are aggregated, and running totals are dealt by range.

Codes are keyed hashes, so cases hold no direct identifier.

Defined results: a null name or track is an empty one, and empty names are alike; ``problems`` lists applications without an id or e-mail,
e-mails that several applications share, and references that occur more than once, which the caller must clear first; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.functions.evidence import short_code
from cohortlens.operators.staging import running


def _digest(code: Column) -> Column:
    return F.conv(F.substring(F.md5(code.cast("binary")), 1, 15), 16, 10).cast("long")


def _cases(df: DataFrame, kind: str, reason: str, version: str, sources: str) -> DataFrame:
    """Case codes: a hash of all that a case rests on."""
    material = F.concat_ws("\n", F.lit(kind), "subject_code", F.lit(reason), F.lit(version), F.lit(sources), F.col("n_candidates").cast("string"), F.col("candidates_xor").cast("string"))
    return df.withColumns({"case_hash": F.sha2(material, 256), "reason": F.lit(reason)}).withColumn("case_code", F.concat(F.lit(kind + "_"), F.substring("case_hash", 1, 16)))


def problems(applications: DataFrame, members: DataFrame) -> DataFrame:
    """``(problem, value, n)``; no rows where planning may begin."""
    blank = lambda c: F.coalesce(text.strip(F.col(c).cast("string")), F.lit("")) == ""
    counted = lambda df, c, what: df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(what).alias("problem"), F.col("value").cast("string").alias("value"), "n")
    incomplete = applications.where(blank("external_id") | blank("email")).groupBy(F.col("external_id").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("incomplete_application").alias("problem"), "value", "n")
    found = incomplete.unionByName(counted(applications.where(~blank("email")), text.email(F.col("email")), "repeated_email"))
    found = found.unionByName(members.where(blank("source_ref")).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("missing_reference").alias("problem"), F.lit(None).cast("string").alias("value"), "n"))
    return found.unionByName(counted(members.where(~blank("source_ref")), text.strip(F.col("source_ref").cast("string")), "repeated_reference"))


def people_plan(applications: DataFrame, members: DataFrame, secret: bytes, sources: str = "") -> DataFrame:
    """source_kind, source_ref, external_id (linked by itself) or else subject_code, n_candidates, candidates_xor, case_code, case_hash, reason.

    ``applications``: external_id, email, name. ``members``: source_kind, source_ref, email, name.
    """
    known = applications.select("external_id", text.email(F.col("email")).alias("_email"), text.team_name(F.col("name")).alias("_name"))
    named = known.where("_name <> ''").groupBy("_name").agg(F.count(F.lit(1)).alias("n_candidates"), F.bit_xor(_digest(short_code("person", F.col("external_id").cast("string"), secret))).alias("candidates_xor"))
    own = members.select("source_kind", "source_ref", text.email(F.col("email")).alias("_email"), text.team_name(F.col("name")).alias("_name"))
    found = own.join(known.where("_email is not null").select("_email", "external_id"), "_email", "left").join(named, "_name", "left")
    subject = short_code("member", F.concat_ws(":", "source_kind", "source_ref"), secret)
    found = found.select("source_kind", "source_ref", "external_id", subject.alias("subject_code"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("candidates_xor", F.lit(0)).cast("long").alias("candidates_xor"))
    found = _cases(found, "identity", "email_mismatch", "identity_rules_v1", sources)
    return _only_open(found, "external_id", ["subject_code", "n_candidates", "candidates_xor", "case_code", "case_hash", "reason"])


def _only_open(df: DataFrame, link: str, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(link).isNull(), F.col(c)) for c in columns})


def identity_candidates(cases: DataFrame, members: DataFrame, applications: DataFrame) -> DataFrame:
    """``(source_kind, source_ref, external_id)`` of the candidates of the identity cases given."""
    names = members.select("source_kind", "source_ref", text.team_name(F.col("name")).alias("_name")).join(cases.select("source_kind", "source_ref"), ["source_kind", "source_ref"], "left_semi")
    known = applications.select("external_id", text.team_name(F.col("name")).alias("_name")).where("_name <> ''")
    return names.join(known, "_name").select("source_kind", "source_ref", "external_id")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_name": text.team_name(F.col("name")), "_track": F.coalesce("track", F.lit(""))})


def taken(preferences: DataFrame, projects: DataFrame) -> DataFrame:
    """``(team_id, project_id, _track, taken_at)``: the projects that teams take by themselves."""
    sole = _keyed(projects).groupBy("_name", "_track").agg(F.count(F.lit(1)).alias("n"), F.min("project_id").alias("project_id")).where("n = 1")
    first = _keyed(preferences).groupBy("_name", "_track").agg(F.min(F.struct("place", "team_id")).alias("f"))
    return first.join(sole, ["_name", "_track"]).select("f.team_id", "project_id", "_track", F.col("f.place").alias("taken_at"))


def team_plan(preferences: DataFrame, projects: DataFrame, secret: bytes, sources: str = "") -> DataFrame:
    """team_id, project_id (taken) or else subject_code, n_candidates, candidates_xor, case_code, case_hash, reason.

    ``preferences``: place (unique), team_id, name, track. ``projects``: project_id, name, track.
    """
    digest = _digest(short_code("project", F.col("project_id").cast("string"), secret))
    all_ = _keyed(projects).groupBy("_track").agg(F.count(F.lit(1)).alias("n_all"), F.bit_xor(digest).alias("xor_all"))
    links = taken(preferences, projects).select("team_id", "project_id", digest.alias("digest"))
    placed = _keyed(preferences).select("place", "team_id", "_track").join(links, "team_id", "left")
    placed = running(placed, ["_track"], ["place"], F.col("project_id").isNotNull().cast("long"), "n_used")
    placed = running(placed, ["_track"], ["place"], F.col("digest"), "xor_used", "xor").join(all_, "_track", "left")
    n = F.coalesce("n_all", F.lit(0)) - F.col("n_used")
    found = placed.select("team_id", "project_id", short_code("team", F.col("team_id").cast("string"), secret).alias("subject_code"), n.alias("n_candidates"), F.coalesce("xor_all", F.lit(0).cast("long")).bitwiseXOR(F.col("xor_used")).alias("candidates_xor"))
    return _only_open(_cases(found, "team", "ambiguous_match", "team_rules_v1", sources), "project_id", ["subject_code", "n_candidates", "candidates_xor", "case_code", "case_hash", "reason"])


def team_candidates(cases: DataFrame, preferences: DataFrame, projects: DataFrame) -> DataFrame:
    """``(team_id, project_id)`` of the candidates of the team cases given."""
    opened = _keyed(preferences).select("team_id", "place", "_track").join(cases.select("team_id"), "team_id", "left_semi")
    used = taken(preferences, projects).select("project_id", "taken_at")
    free = _keyed(projects).select("project_id", "_track").join(used, "project_id", "left")
    return opened.join(free, "_track").where("taken_at is null or taken_at >= place").select("team_id", "project_id")


# The decisions on an identity, and those that name a person.
WITH_PERSON, DECISIONS = ("linked", "kept_separate", "merged_with_email_mismatch"), ("linked", "kept_separate", "merged_with_email_mismatch", "quarantined")
_DECIDED = ["source_record_id", "person_id", "decision", "reviewer", "reason", "decided_at", "supersedes"]


def open_candidates(reviews: DataFrame, records: DataFrame, files: DataFrame, event: int) -> DataFrame:
    """Open reviews of one event. ``reviews``: review_id, source_record_id, provisional_person_id, suggested_person_id, reason_code, status."""
    of = records.select("source_record_id", "source_file_id").join(files.where(F.col("event_id") == event).select("source_file_id"), "source_file_id", "left_semi")
    return reviews.where("status = 'open'").join(of, "source_record_id", "left_semi").select("review_id", "source_record_id", "provisional_person_id", "suggested_person_id", "reason_code")


def checked_decisions(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (place and the fields below) with ``decision_id`` and ``status``: ``applied``, ``replayed``, or what is wrong.

    ``log``: decision_id, source_record_id, person_id, decision, reviewer, reason, decided_at, supersedes. A decision that is current as it stands is
    replayed under its id; any other must supersede the current one of its record, or nothing where there is none. Numbers of
    new decisions go on from the log's greatest, by place, though none is to be written while any is wrong.
    """
    newer = log.where("supersedes is not null").select(F.col("supersedes").alias("decision_id"))
    now = log.join(newer, "decision_id", "left_anti").select("source_record_id", F.col("decision_id").alias("_now"), F.struct(*_DECIDED).alias("_fields"))
    found = decisions.select("place", *_DECIDED).join(now, "source_record_id", "left")
    blank = lambda c: F.coalesce(text.strip(F.col(c)), F.lit("")) == ""
    replayed = F.col("_now").isNotNull() & F.col("_fields").eqNullSafe(F.struct(*_DECIDED))
    status = (
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "invalid_decision").when(F.col("decision").isin(*WITH_PERSON) & F.col("person_id").isNull(), "missing_person")
        .when((F.col("decision") == "quarantined") & F.col("person_id").isNotNull(), "person_given").when(blank("reviewer") | blank("reason"), "missing_reviewer").when(replayed, "replayed")
        .when(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("supersedes")), "not_current").when(F.col("_now").isNull() & F.col("supersedes").isNotNull(), "nothing_to_supersede").otherwise("applied")
    )
    found = found.withColumn("status", status)
    twice = found.where("status = 'applied'").groupBy("source_record_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = found.join(twice, "source_record_id", "left").withColumn("status", F.when((F.col("status") == "applied") & F.col("_n").isNotNull(), "repeated").otherwise(F.col("status")))
    found = running(found.select("place", *_DECIDED, "status", "_now"), [], ["place"], (F.col("status") == "applied").cast("long"), "_before")
    last = log.agg(F.coalesce(F.max("decision_id"), F.lit(0)).alias("_last"))
    number = F.when(F.col("status") == "applied", F.col("_last") + F.col("_before") + 1).when(F.col("status") == "replayed", F.col("_now"))
    return found.crossJoin(F.broadcast(last)).select("place", *_DECIDED, number.alias("decision_id"), "status")  # one row


def appended(log: DataFrame, checked: DataFrame) -> DataFrame:
    """The rows to add to the log; an error while any decision is wrong, so that all are applied or none."""
    wrong = checked.where("status not in ('applied', 'replayed')").first()
    if wrong:
        raise ValueError(f"decision {wrong['place']} on record {wrong['source_record_id']}: {wrong['status']}")
    return checked.where("status = 'applied'").select(*log.columns)


def resolved_reviews(reviews: DataFrame, checked: DataFrame) -> DataFrame:
    """``reviews`` with those of decided records resolved."""
    decided = checked.where("status in ('applied', 'replayed')").groupBy("source_record_id").agg(F.max("decided_at").alias("_at"))
    hit = (F.col("status") == "open") & F.col("_at").isNotNull()
    found = reviews.join(decided, "source_record_id", "left")
    return found.withColumns({"status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_at": F.when(hit, F.col("_at")).otherwise(F.col("resolved_at"))}).select(*reviews.columns)
