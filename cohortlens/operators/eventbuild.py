"""One event from its mapped sources: applications, attendance, teams and submissions become relations that refer to each other.

A row is kept, or rejected (its applicant is unknown, or it lacks the id of its team or project), or set apart as a conflict: its
record id stands twice in a source whose ids must be unique, or its team or project is described in more than one way. All rows of
such a team or project are set apart, as which description holds can't be known. Each role's rows are stored once, in its own columns
and with ids as they were given; contested keys are stored too, all relations are read from these tables, and ``outcomes`` accounts for
every row. The shuffle files of a step go with it. References, many times as long as ids, are made last. Nothing gathers a group: descriptions of a team or project are
compared by their smallest and largest, whatever their number, and rows meet a population or conflicts with one row for each key,
so that a hot key's rows can be split (AQE does).

Null or empty identities: an identity like any other where the mapping lets them through; null ids and tracks count as absent,
and an absent track differs from a given one; repeated rows with equal content are kept and give one member, team or project (but
as many attendance rows); empty sources give empty relations; columns beside those read are left out; texts may have any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.text import stable_reference, strip
from cohortlens.operators.staging import stored

# The fields that a role's mapping must have, and those that it may have.
NEEDED = {"applications": (), "attendance": ("approval_status", "checked_in_at"), "teams": ("team_id", "track"), "submissions": ("project_id", "team_id", "submission_status", "track")}
OPTIONAL = {"applications": ("github",), "submissions": ("repository", "demo")}
TEAM, PROJECT = ["track"], ["team", "yes", "track", "repository_supplied", "demo_supplied"]


@dataclass(frozen=True)
class Source:
    """The mapped rows of a role (``row_number, source_partition, external_record_id, applicant_identity`` and its fields), null where an optional source is missing."""

    rows: DataFrame | None
    #: Rows ``(row_number, source_partition)`` that could not be mapped.
    rejects: DataFrame | None = None
    #: Lower-cased states that count as a yes.
    positive: tuple[str, ...] = ()
    required: bool = False
    #: A record id that stands twice (on several sheets, say) is a conflict.
    unique_ids: bool = False


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _text(df: DataFrame, name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit(""))) if name in df.columns else F.lit("")


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def _staged(role: str, source: Source) -> DataFrame:
    """A role's rows in its own columns, ids as they were given."""
    df, fields = source.rows, NEEDED[role] + OPTIONAL.get(role, ())
    missing = [f for f in NEEDED[role] if f not in df.columns]
    if missing:
        raise ValueError(f"{role} lacks {', '.join(missing)}")
    supplied = lambda f: (_text(df, f) != "") if f in df.columns else F.lit(None).cast("boolean")
    positive = lambda f: F.when(F.lower(_text(df, f)).isin(*source.positive), True)
    made = {
        "github": (_text(df, "github") != "").alias("github"), "approval_status": positive("approval_status").alias("yes"), "submission_status": positive("submission_status").alias("yes"), "checked_in_at": F.when(_text(df, "checked_in_at") != "", True).alias("present"),
        "team_id": _given(_text(df, "team_id")).alias("team"), "project_id": _given(_text(df, "project_id")).alias("project"), "track": _given(_text(df, "track")).alias("track"), "repository": supplied("repository").alias("repository_supplied"), "demo": supplied("demo").alias("demo_supplied"),
    }
    return df.select(
        F.col("row_number").cast("long").alias("row_number"), F.col("source_partition").cast("string").alias("source_partition"), F.coalesce("external_record_id", F.lit("")).alias("external_record_id"), F.coalesce("applicant_identity", F.lit("")).alias("identity"), *[made[f] for f in fields],
    )


def _contested(claims: DataFrame, key: str, described: list[str]) -> DataFrame:
    """Keys that are described in more than one way; a null is a value of its own."""
    what = F.struct(*described)
    found = claims.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(what).alias("a"), F.max(what).alias("b"))
    return stored(found.where("not (a <=> b)").select(F.concat(F.lit("="), F.col(key)).alias("_key"), F.lit(True).alias(f"{key}_contested")), "event-contested", tidy=True)


def _told(rows: DataFrame, contested: dict[str, DataFrame]) -> DataFrame:
    """Rows with the conflict that they are part of; those without a key take one of their own, so that nulls don't pile up."""
    problem = F.lit(None).cast("string")
    for key, found in contested.items():
        own = F.coalesce(F.concat(F.lit("="), F.col(key)), F.concat_ws(":", F.lit("row"), "row_number", "source_partition"))
        rows = rows.withColumn("_key", own).join(found, "_key", "left").drop("_key")
        problem = F.coalesce(problem, F.when(F.col(f"{key}_contested"), key))
    return rows.withColumn("conflict", F.coalesce("conflict", F.when(F.col("reason").isNull(), problem))).drop(*[f"{key}_contested" for key in contested])


def build(spark: SparkSession, event: str, sources: dict[str, Source]) -> dict[str, DataFrame]:
    """The relations ``applicants, applicant_sources, attendance, teams, projects, team_members, project_members``, and ``outcomes`` of rows and ``coverage`` of sources."""
    if set(sources) - set(NEEDED) or "applications" not in sources or sources["applications"].rows is None:
        raise ValueError("applications are needed, and other roles than attendance, teams and submissions unknown")
    absent = [r for r, s in sources.items() if s.rows is None and s.required]
    if absent:
        raise ValueError(f"required sources are missing: {', '.join(absent)}")
    given = {r: s for r, s in sources.items() if s.rows is not None}
    staged = {}
    for role, source in given.items():
        rows = _staged(role, source)
        if source.unique_ids:
            doubled = rows.groupBy("external_record_id").count().where("count > 1")
            staged[role] = rows.join(doubled.select("external_record_id", F.lit("doubled_record").alias("conflict")), "external_record_id", "left")
        else:
            staged[role] = rows.withColumn("conflict", F.lit(None).cast("string"))
    applied = stored(staged["applications"].where("conflict is null").select("identity").distinct().withColumn("known", F.lit(True)), "event-applicants", tidy=True)
    tables, given_ids = {}, {role: rows.select("identity").distinct() for role, rows in staged.items()}
    for role, rows in staged.items():
        lacking = {"teams": "team is null", "submissions": "project is null"}.get(role, "false")
        reason = F.when(F.col("conflict").isNotNull(), None).when(F.col("known").isNull(), "invalid_relation").when(F.expr(lacking), "malformed_record")
        # The known ones among a role's own identities: where these are few, its rows need no shuffle.
        known = applied if role == "applications" else stored(given_ids[role].join(applied, "identity"), "event-known", tidy=True)
        tables[role] = stored(rows.join(known, "identity", "left").withColumn("reason", reason).drop("known"), "event-rows", compression="zstd", tidy=True)

    # An absent source has no rows; its columns are those that the relations need.
    for role in set(NEEDED) - set(tables):
        none = spark.createDataFrame([], "row_number long, source_partition string, external_record_id string, applicant_identity string, " + ", ".join(f"{f} string" for f in NEEDED[role]))
        tables[role] = _staged(role, Source(none)).withColumns({"conflict": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})

    valid = {r: t.where("reason is null and conflict is null") for r, t in tables.items()}
    teams = _contested(_union([valid[r].select("team", *TEAM) for r in ("teams", "submissions")]), "team", TEAM)
    projects = _contested(valid["submissions"], "project", PROJECT)
    told = tables | {"teams": _told(tables["teams"], {"team": teams}), "submissions": _told(tables["submissions"], {"team": teams, "project": projects})}
    kept = {r: t.where("reason is null and conflict is null") for r, t in told.items()}

    ref = lambda kind, how, value: stable_reference(F.lit(event), F.lit(kind), F.lit(how), value)
    applicant = ref("applicant", "canonical_content_key", F.col("identity")).alias("applicant_ref")
    record = lambda role: ref("source_record", "provider_id", F.concat(role, F.lit(":"), F.col("external_record_id"))).alias("source_ref")
    keyed = lambda kind: F.when(F.col(kind).isNotNull(), ref(kind, "provider_id", F.col(kind))).alias(f"{kind}_ref")
    columns = ["role", "row_number", "source_partition", "reason", "conflict"]
    refused = [told[r].withColumn("role", F.lit(r)).select(*columns) for r in given]
    refused += [s.rejects.select(F.lit(r).alias("role"), F.col("row_number").cast("long"), F.col("source_partition").cast("string"), F.lit("missing_stable_id").alias("reason"), F.lit(None).cast("string").alias("conflict")) for r, s in given.items() if s.rejects is not None]
    outcome = F.when(F.col("conflict").isNotNull(), "conflict").when(F.col("reason").isNotNull(), "rejected").otherwise("kept")
    # A row that lacks an id still is a source of its applicant.
    sources_of = [told[r].where("conflict is null and coalesce(reason, '') <> 'invalid_relation'").select("identity", F.lit(r).alias("role"), "external_record_id", (F.col("github") if r == "applications" else F.lit(False)).alias("github")) for r in given]
    pairs = _union(sources_of).groupBy("identity", "role", "external_record_id").agg(F.max("github").alias("github"))
    members = lambda rows, kind: rows.select(kind, "identity").distinct().select(keyed(kind), applicant)
    named = _union([kept[r].where("team is not null").select("team", *TEAM) for r in ("teams", "submissions")])
    described = kept["submissions"].where("project is not null").select("project", *PROJECT).distinct()
    return {
        "applicants": pairs.groupBy("identity").agg(F.max("github").alias("github_supplied"), F.count(F.lit(1)).alias("n_sources")).select(applicant, "github_supplied", "n_sources"),
        "applicant_sources": pairs.select(applicant, record(F.col("role"))),
        "attendance": kept["attendance"].select(applicant, record(F.lit("attendance")), F.col("yes").alias("accepted"), "present"),
        "teams": named.distinct().select(keyed("team"), *TEAM),
        "projects": described.select(keyed("project"), keyed("team"), F.col("yes").alias("submitted"), *PROJECT[2:]),
        "team_members": members(kept["teams"], "team"),
        "project_members": members(kept["submissions"].where("yes"), "project"),
        "outcomes": _union(refused).select("role", "row_number", "source_partition", outcome.alias("outcome"), F.coalesce("conflict", "reason").alias("problem")),
        "coverage": spark.createDataFrame([(r, s.required, "missing_optional" if s.rows is None else "available") for r, s in sorted(sources.items())], "role string, required boolean, state string"),
    }


def accounts(outcomes: DataFrame) -> DataFrame:
    """``(role, n_in, n_kept, n_rejected, n_conflicts)``: what came in is what was kept, rejected or set apart."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("role").agg(F.count(F.lit(1)).alias("n_in"), n("kept").alias("n_kept"), n("rejected").alias("n_rejected"), n("conflict").alias("n_conflicts"))


def integrity(relations: dict[str, DataFrame]) -> DataFrame:
    """``(rule, ref)`` of each broken reference and each doubled one; ``build`` leaves none, tables from elsewhere may have some.

    A null reference is broken, save that a project needs no team.
    """
    keys = {"applicants": ["applicant_ref"], "teams": ["team_ref"], "projects": ["project_ref"], "team_members": ["team_ref", "applicant_ref"], "project_members": ["project_ref", "applicant_ref"]}
    found = [relations[t].groupBy(*k).count().where("count > 1").select(F.lit(f"{t}: doubled").alias("rule"), F.col(k[0]).alias("ref")) for t, k in keys.items()]
    parents = {"applicant_ref": relations["applicants"].select("applicant_ref"), "team_ref": relations["teams"].select("team_ref"), "project_ref": relations["projects"].where("submitted").select("project_ref")}
    children = [("team_members", "team_ref"), ("team_members", "applicant_ref"), ("project_members", "project_ref"), ("project_members", "applicant_ref"), ("attendance", "applicant_ref"), ("projects", "team_ref")]
    for name, key in children:
        child = relations[name].where(F.col(key).isNotNull()) if name == "projects" else relations[name]
        found.append(_repeated(child.groupBy(key).count().join(parents[key], key, "left_anti"), key).select(F.lit(f"{name}: unknown {key}").alias("rule"), F.col(key).alias("ref")))
    return _union(found)


#: Rows that a part of a key gives at once.
PART_ROWS = 10_000


def _repeated(counted: DataFrame, key: str) -> DataFrame:
    """A row for each of a key's ``count``; a key of many is dealt out in parts, as rows of one key met in a join would all go to one task."""
    parts = counted.select(key, "count", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {PART_ROWS}"))).alias("_part")).repartition(key, "_part")
    size = F.least(F.lit(PART_ROWS).cast("long"), F.col("count") - F.col("_part") * PART_ROWS).cast("int")
    return parts.select(key, F.explode(F.array_repeat(F.lit(0), size)).alias("_n")).select(key)
