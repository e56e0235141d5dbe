"""Retention, rights, asset use, release state, idempotent ingest and erasure, as batch rewrites over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.matching import latest


def retained(records: DataFrame, observed: str, payload: str, now: Column, days: int = 365) -> DataFrame:
    """Payloads observed before the cutoff become null; ``erased`` says which."""
    expired = F.col(observed) < now - F.make_dt_interval(F.lit(days))
    erased = expired & F.col(payload).isNotNull()
    return records.withColumns({"erased": erased, payload: F.when(~expired, F.col(payload))})


def ghosted(table: DataFrame, people: DataFrame, person: str, columns: list[str]) -> DataFrame:
    """The personal columns of the people who are erased become null."""
    gone = people.select(F.col(person), F.lit(True).alias("_gone")).distinct()
    marked = table.join(gone, person, "left")
    return marked.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in columns}).drop("_gone")


def rights_latest(log: DataFrame, subject: str, order: str, state: str) -> DataFrame:
    return latest(log, [subject], order, state)


def publishable(members: DataFrame, rights: DataFrame, subject: str, state: str, allowed: list[str]) -> DataFrame:
    """Members whose latest state allows it; a subject without a state is excluded."""
    return members.join(rights.where(F.col(state).isin(*allowed)).select(subject), subject, "left_semi")


def asset_use(assets: DataFrame, approvals: DataFrame, rights: DataFrame, now: Column) -> DataFrame:
    """Why an asset may or may not be used; the first reason counts."""
    found = assets.join(approvals, "asset_id", "left").join(rights.select("subject", "state"), "subject", "left")
    why = (
        F.when(~F.array_contains("allowed_uses", F.col("wanted_use")), "use_not_allowed").when(F.col("expires_at") <= now, "expired")
        .when(F.coalesce(F.col("state"), F.lit("excluded")) == "excluded", "subject_excluded").when(F.col("approved_from").isNull(), "not_approved")
        .when((now < F.col("approved_from")) | (now >= F.col("approved_until")), "outside_window").otherwise("allowed")
    )
    return found.select("asset_id", "subject", why.alias("decision"))


def release_state(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Blocked, needs review or safe: ``evidence`` has kind (inventory, parity, review, approval) and ok."""
    bad = lambda kind: F.coalesce(F.bool_or((F.col("kind") == kind) & ~F.col("ok")), F.lit(False))
    has = lambda kind: F.bool_or((F.col("kind") == kind) & F.col("ok"))
    found = evidence.groupBy(*by).agg(bad("inventory").alias("i"), bad("parity").alias("p"), bad("review").alias("r"), has("approval").alias("a"))
    return found.select(*by, F.when(F.col("i") | F.col("p"), "Blocked").when(F.col("r") | ~F.col("a"), "Needs review").otherwise("Safe").alias("state"))


def new_files(arrivals: DataFrame, manifest: DataFrame) -> DataFrame:
    """Arrivals whose (digest, source_type, event) the manifest doesn't have, each once."""
    key = ["digest", "source_type", "event"]
    return arrivals.join(manifest.select(*key), key, "left_anti").groupBy(*key).agg(F.min("arrival").alias("arrival"))


def eligible(people: DataFrame, reviews: DataFrame, consents: DataFrame) -> DataFrame:
    """Active people without an open review and without a current denial."""
    denied = consents.where(~F.col("granted")).select("person_id").distinct()
    return people.where("state = 'active'").join(reviews.where("status = 'open'").select("person_id"), "person_id", "left_anti").join(denied, "person_id", "left_anti")
