"""Source rows flattened to people, reviews and corrections applied, caches and ledgers read. Nothing vanishes silently: what fails is returned with its problem."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators.matching import latest


def split_people(c: Column) -> Column:
    """The parts of a list of people, stripped, empty ones left out; null is no one."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,;|]+"), text.strip), lambda p: p != "")


def preference_people(rows: DataFrame, emails: str, names: str) -> DataFrame:
    """A row for each e-mail with ``ordinal`` from 1, ``email`` and ``name``: the name in its place, or ``Member`` and the ordinal."""
    rest = [c for c in rows.columns if c not in (emails, names)]
    people = rows.select(*rest, split_people(F.col(names)).alias("_names"), F.posexplode(split_people(F.col(emails))).alias("_at", "email"))
    name = F.coalesce(F.get("_names", F.col("_at")), F.concat(F.lit("Member "), (F.col("_at") + 1).cast("string")))
    return people.select(*rest, (F.col("_at") + 1).alias("ordinal"), "email", name.alias("name"))


def project_people(rows: DataFrame, members: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each of the member columns (first name, last name, e-mail) that has an e-mail; ordinals are kept."""
    rest = [c for c in rows.columns if c not in {x for m in members for x in m}]
    clean = lambda c: F.nullif(text.strip(F.col(c)), F.lit(""))
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), clean(e).alias("email"), F.concat_ws(" ", clean(a), clean(b)).alias("name")) for i, (a, b, e) in enumerate(members, 1)])
    people = rows.select(*rest, F.explode(parts).alias("_m")).where("_m.email is not null").select(*rest, "_m.*")
    return people.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("Member "), F.col("ordinal").cast("string"))).otherwise(F.col("name")))


def overridden(counts: DataFrame, corrections: DataFrame, event: str) -> DataFrame:
    """``counts`` (field, value) after ``corrections`` (field, stable_key, source_value, corrected_value, reason, evidence_note), and each correction's ``problem``.

    A correction replaces a value only if it names this event and field, knows the value it replaces, and is complete.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    repeats = corrections.groupBy("field").agg(F.count(F.lit(1)).alias("_n"))
    found = corrections.join(repeats, "field").join(counts.withColumn("_known", F.lit(True)), "field", "full")
    problem = (
        F.when(F.col("_n").isNull(), F.lit(None)).when(F.col("_n") > 1, "duplicate").when(F.col("_known").isNull(), "unknown")
        .when(~F.col("stable_key").eqNullSafe(F.concat(F.lit(f"event:{event}:"), "field")), "event").when(~F.col("source_value").eqNullSafe(F.col("value")), "drift")
        .when(F.coalesce(F.col("corrected_value") < 0, F.lit(True)), "value").when(~(filled("reason") & filled("evidence_note")), "incomplete")
    )
    found = found.withColumn("problem", problem)
    return found.select("field", F.when(F.col("_n").isNotNull() & F.col("problem").isNull(), F.col("corrected_value")).otherwise(F.col("value")).alias("value"), "problem")


def evaluation_candidates(applications: DataFrame, attendance: DataFrame, secret: bytes) -> DataFrame:
    """Applications (external_id, email, linkedin) with a valid profile, by how far they came; attendance (email, accepted, checked_in) of others is left out."""
    came = attendance.groupBy("email").agg(F.bool_or("accepted").alias("accepted"), F.bool_or("checked_in").alias("checked_in"))
    priority = F.when(F.col("checked_in"), "checked_in").when(F.col("accepted"), "accepted_not_checked_in").otherwise("other")
    found = applications.withColumn("profile", text.linkedin(F.col("linkedin"))).where("profile is not null").join(came, "email", "left")
    ref = F.concat(F.lit("source:application:"), F.substring(text.hmac_sha256(F.col("external_id"), secret), 1, 24))
    return found.select("external_id", "profile", ref.alias("source_record_ref"), priority.alias("priority"))


def resolved_links(exact: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links (source_ref, person) that are exact or approved; of decisions (source_ref, action, person) others quarantine, and none leaves it unresolved.

    Decisions of one reference that don't agree are a ``conflict`` without a person, and one row like all.
    """
    action, approved = F.col("action"), F.col("action") == "approve"
    state = F.when(action.isNull(), "unresolved").when(approved, "approved").otherwise("quarantined")
    each = decisions.select("source_ref", F.struct(F.when(approved, F.col("person")).alias("person"), state.alias("link")).alias("d"))
    one = each.groupBy("source_ref").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    decided = one.select("source_ref", F.when(same, F.col("a.person")).alias("person"), F.when(same, F.col("a.link")).otherwise("conflict").alias("link"))
    return exact.join(decided, "source_ref", "left_anti").select("source_ref", "person", F.lit("exact").alias("link")).unionByName(decided)


def refreshed(cases: DataFrame, previous: DataFrame) -> DataFrame:
    """``cases`` (case_code, case_hash) with the ``decision`` of the case of that code and hash before; else, or where several disagree, it is open again."""
    old = previous.groupBy("case_code", F.col("case_hash").alias("_hash")).agg(F.min("decision").alias("_a"), F.max("decision").alias("_b"), F.count_if(F.col("decision").isNull()).alias("_open"))
    old = old.select("case_code", "_hash", F.when(F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_open") == 0), F.col("_a")).alias("decision"))
    found = cases.withColumn("_hash", F.col("case_hash")).join(old, ["case_code", "_hash"], "left")
    return found.drop("_hash")


def validation_support(bands: Column) -> Column:
    """``bands`` of stars and forks of the projects that are cited."""
    notable = F.size(F.filter(bands, lambda b: b == "notable"))
    return F.when(F.coalesce(F.array_contains(bands, "high"), F.lit(False)) | (notable >= 2), "strong").when(notable == 1, "meaningful").otherwise("none")


def classification_problem(occupation: Column, signal: Column, fact: Column, confidence: Column, occupations: list[str], signals: list[str]) -> Column:
    """The first thing that is wrong with a classification, or null."""
    inside = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    sure = F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False))
    return F.when(~inside(occupation, occupations), "occupation").when(~inside(signal, signals), "signal").when(F.length(fact) > 500, "fact").when(~sure, "confidence")


def claim_scores(cases: DataFrame, expected: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """Claims found, missed and made up over all cases, and precision and recall in whole basis points; nothing to find is 10000."""
    hit, made_up, missed = (F.size(f(a, b)) for f, a, b in ((F.array_intersect, expected, predicted), (F.array_except, predicted, expected), (F.array_except, expected, predicted)))
    sums = cases.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(made_up).alias("fp"), F.sum(missed).alias("fn"), F.count_if((made_up > 0) | (missed > 0)).alias("error_cases"))
    points = lambda other: F.when(F.col("tp") + F.col(other) == 0, F.lit(10_000)).otherwise(F.floor(F.col("tp") * 10_000 / (F.col("tp") + F.col(other))))
    return sums.withColumns({"precision": points("fp").cast("long"), "recall": points("fn").cast("long")})


def identity_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


#: First words of literals that are sent to all tasks; with more of them every n-gram of a text is joined.
FIRST_WORDS = 100_000


def known_literals(texts: DataFrame, key: str, column: str, literals: DataFrame, literal: str, first_words: int = FIRST_WORDS) -> DataFrame:
    """``(key, form)``: the known literals (of four characters or more) that occur as whole words in a text.

    Word n-grams, of the lengths that the literals have, are joined to them by equality: no text meets each literal. Where the
    literals begin with few different words, only n-grams that begin with one of these are made, of the lengths that go with it.
    """
    words = F.col("_w")
    forms = literals.select(identity_words(F.col(literal)).alias("_w")).select(F.array_join(words, " ").alias("form"), F.get(words, 0).alias("first"), F.size(words).alias("n")).where("length(replace(form, ' ', '')) >= 4").distinct()
    found = texts.select(key, identity_words(F.col(column)).alias("_w"))
    firsts = forms.select("first", "n").distinct()
    if firsts.count() <= first_words:
        at = found.select(key, "_w", F.posexplode("_w").alias("i", "first")).join(F.broadcast(firsts), "first").where(F.col("i") + F.col("n") <= F.size("_w"))
        grams = at.select(key, F.array_join(F.slice("_w", F.col("i") + 1, F.col("n")), " ").alias("form"))
    else:
        lengths = sorted(r["n"] for r in forms.select("n").distinct().collect())  # a handful of numbers

        def every(n: int) -> Column:
            made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
            return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))

        grams = found.select(key, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(every, lengths)))).alias("form"))
    return grams.join(forms.select("form"), "form").select(key, "form").distinct()


def excluded_attendance(records: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matches, unlinked)`` by e-mail: the attendance of excluded people, and exclusions that no attendance has, which must be none."""
    wanted = excluded.select(text.email(F.col("email")).alias("_e")).distinct()
    keyed = records.withColumn("_e", text.email(F.col("email")))
    return keyed.join(wanted, "_e", "left_semi").drop("_e"), wanted.join(keyed.select("_e"), "_e", "left_anti").select(F.col("_e").alias("email"))


def cache_key(namespace: str, version: str, inputs: list[str]) -> Column:
    """``namespace:digest`` of the canonical JSON of the inputs, by name and with their nulls, and the version."""
    if not re.fullmatch("[a-z][a-z0-9_-]{0,47}", namespace):
        raise ValueError(f"not a cache namespace: {namespace}")
    canonical = F.to_json(F.struct(F.struct(*sorted(inputs)).alias("inputs"), F.lit(version).alias("version")), {"ignoreNullFields": "false"})
    return F.concat(F.lit(namespace + ":"), F.sha2(canonical, 256))


def cached(requests: DataFrame, cache: DataFrame, namespace: str, version: str, inputs: list[str], now: Column) -> DataFrame:
    """``requests`` with the ``payload`` of the cache (cache_key, payload, expires_at) that has their key and hasn't expired, else null."""
    live = cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(F.max_by("payload", "expires_at").alias("payload"))
    return requests.withColumn("cache_key", cache_key(namespace, version, inputs)).join(live, "cache_key", "left")


def without_expired(cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The entries that are kept, and a receipt (cache_key, expires_at) for each that is deleted; one without an end has expired."""
    over = F.coalesce(F.col("expires_at") <= now, F.lit(True))
    return cache.where(~over), cache.where(over).select("cache_key", "expires_at")


def ledger(log: DataFrame, subject: str, order: str) -> DataFrame:
    """A run's subjects: the state they are in (log: state, cost), how often they were reserved, and their cost so far."""
    sums = log.groupBy(subject).agg(F.count_if(F.col("state") == "reserved").alias("attempts"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))
    return latest(log, [subject], order, "state").join(sums, subject).select(subject, "state", "attempts", "cost")


def parity(left: DataFrame, right: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Keys (key, value) whose values differ between two contracts, or that only one has; ``aliases`` renames the left one's keys."""
    key = F.col("key")
    for a, b in aliases.items():
        key = F.when(key == a, F.lit(b)).otherwise(key)
    a = left.select(key.alias("key"), F.struct("value").alias("a"))
    both = a.join(right.select("key", F.struct("value").alias("b")), "key", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("key", F.col("a.value").alias("left_value"), F.col("b.value").alias("right_value"))


def source_notes(roles: DataFrame, coverage: DataFrame) -> DataFrame:
    """Of each role (role, required) whether its source is there, and the problem of a required one that isn't."""
    found = roles.join(coverage.groupBy("role").agg(F.lit(True).alias("_there")), "role", "left")
    state = F.when(F.col("_there"), "available").when(F.col("required"), "unavailable").otherwise("missing_optional")
    return found.select("role", state.alias("state"), F.when(state == "unavailable", "required_source").alias("problem"))
