"""Evidence joined to people and summed up: aliases, erased people, repositories, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import evidence
from cohortlens.functions.text import hmac_sha256


def aliased(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``records`` (source_type, external_id) with ``alias_person``, the person a reviewer bound the record to, or null. Aliases that name several persons bind to none (``alias_conflicts``)."""
    one = aliases.groupBy("source_type", "external_id").agg(F.min("person_id").alias("_a"), F.max("person_id").alias("_b")).where("_a = _b")
    return records.join(one.select("source_type", "external_id", F.col("_a").alias("alias_person")), ["source_type", "external_id"], "left")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Records that an alias file names more than once, which its loader must refuse."""
    return aliases.groupBy("source_type", "external_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ghost_matches(rows: DataFrame, ghosts: DataFrame, email: Column, secrets: dict[str, bytes]) -> DataFrame:
    """``rows`` with ``ghost_person``: the erased person (person_id, key_version, identity_hmac) whose token the e-mail gives, or null; these rows must not enter.

    Each key version, few of them, is a join by the token's equality; a version without a secret is an error.
    """
    configured = F.when(F.col("key_version").isin(*secrets), F.col("key_version")).otherwise(F.raise_error(F.concat(F.lit("no secret for key version "), F.col("key_version"))))
    known = ghosts.withColumn("key_version", configured).groupBy("key_version", "identity_hmac").agg(F.min("person_id").alias("_person"))
    found, persons = rows, []
    for i, (version, secret) in enumerate(sorted(secrets.items())):
        persons.append(f"_p{i}")
        side = known.where(F.col("key_version") == version).select(F.col("identity_hmac").alias("_token"), F.col("_person").alias(persons[-1]))
        found = found.withColumn("_token", hmac_sha256(email, secret)).join(side, "_token", "left").drop("_token")
    return found.withColumn("ghost_person", F.array_min(F.array(*persons))).drop(*persons)


def repository_rollup(repositories: DataFrame, owner: str, now: Column) -> DataFrame:
    """By owner the repositories that are their own work and live (neither fork, archived nor disabled), with stars, forks, recent pushes and language codes."""
    own = ~(F.col("fork") | F.col("archived") | F.col("disabled"))
    code = evidence.mapped(evidence.LANGUAGES, F.lower("language"))
    total = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0))
    return repositories.groupBy(owner).agg(
        F.count_if(own).alias("owned"), total("stars").alias("stars"), total("forks").alias("forks"),
        F.count_if(own & (F.col("pushed_at") >= now - F.expr("INTERVAL 365 DAYS"))).alias("recent"), F.sort_array(F.collect_set(F.when(own, code))).alias("technologies"),
    )


def positive_claims(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sum of ``n`` over cells (dimension, cell) that claim something."""
    none = F.coalesce(evidence.mapped(evidence.NEGATIVE, F.col("dimension")) == F.col("cell"), F.lit(False))
    return cells.where((F.col("cell") != "unknown") & ~none).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"))


def confidence(cells: DataFrame, denominator: str) -> DataFrame:
    """By dimension how many are unknown, and how many a rule matched; null where the unknown cell is withheld or missing."""
    unknown = F.max(F.when(F.col("cell").isin("unknown", "insufficient_evidence"), F.col("n")))
    return cells.groupBy("dimension").agg((F.max(denominator) - unknown).alias("explicit_rule_match"), unknown.alias("unknown"))
