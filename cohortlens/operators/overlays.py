"""Career facts laid over reviewed classifications: what changes, and which reviews open again.

A classification has dimensions (name to labels, confidence, evidence_refs, state). Facts are laid over in a fixed order: company,
seniority, title, founder history. Facts whose fingerprint is the one that was laid over last are left alone. A seniority other than
the one observed, and a claim to have founded something, open the review again, and so does any change where a reviewer had
corrected the output, which the facts are then laid over. The result holds the changed rows alone, to be put into a
:class:`~cohortlens.sources.versioned.VersionedTable`; a join by subject and otherwise a map.

Defined results: ``problems`` lists facts that may not be laid over (twice for one subject, about nobody in the population, not observed, fields or evidence
missing); a dimension that the classification lacks is not made; null labels and evidence count as none; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seniority labels of the facts, and company categories of a start-up.
SENIORITY = {
    "founder": "founder", "junior": "junior", "mid": "mid_level", "mid_level": "mid_level", "senior": "senior", "lead": "lead_staff_executive", "staff": "lead_staff_executive",
    "principal": "lead_staff_executive", "executive": "lead_staff_executive", "director": "lead_staff_executive", "head": "lead_staff_executive",
}
STARTUP = ("startup", "scaleup", "venture_backed_startup")
EMPTY_LABELS = ("unknown", "insufficient_evidence")
CONFIDENCE = 0.8
DIMENSION = "struct<labels:array<string>,confidence:double,evidence_refs:array<string>,state:string>"


def problems(base: DataFrame, facts: DataFrame) -> DataFrame:
    """``(subject_ref, problem)``; no rows where the facts may be laid over."""
    missing = F.col("state").isNull() | (F.col("state") != "observed") | F.col("founder_history").isNull() | ~F.coalesce(F.col("evidence_ref").rlike("^evidence:[a-z]+:[0-9a-f]{64}$"), F.lit(False))
    found = facts.groupBy("subject_ref").agg(F.count(F.lit(1)).alias("n"), F.bool_or(missing).alias("bad"))
    found = found.join(base.select("subject_ref", F.lit(True).alias("there")).distinct(), "subject_ref", "left")
    problem = F.when(F.col("there").isNull(), "outside_population").when(F.col("n") > 1, "repeated").when(F.col("bad"), "invalid")
    return found.select("subject_ref", problem.alias("problem")).where("problem is not null")


def fingerprint(facts: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct("company_category", "founder_history", "seniority", "title_category"), {"ignoreNullFields": "false"}), 256)


def _labels(dimension: Column) -> Column:
    return F.coalesce(dimension["labels"], F.array().cast("array<string>"))


def _with(dimension: Column, labels: Column, confidence: Column) -> Column:
    refs = F.coalesce(dimension["evidence_refs"], F.array().cast("array<string>"))
    return F.struct(labels.alias("labels"), confidence.alias("confidence"), F.array_sort(F.array_union(refs, F.array("evidence_ref"))).alias("evidence_refs"), F.lit("observed").alias("state"))


def laid_over(base: DataFrame, facts: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """The rows of ``base`` that ``facts`` change.

    ``base``: subject_ref, dimensions, review_reasons, review_state, fingerprint. ``facts``: subject_ref, company_category, seniority, title_category,
    founder_history, evidence_ref. ``corrections``: subject_ref, dimensions.
    """
    marked = facts.select(*[c for c in facts.columns if c not in ("state", "fingerprint")], fingerprint(facts).alias("_new"))
    found = base.join(marked, "subject_ref").where(~F.col("fingerprint").eqNullSafe(F.col("_new")))
    if corrections is not None:
        found = found.join(corrections.select("subject_ref", F.col("dimensions").alias("_corrected")), "subject_ref", "left")
    else:
        found = found.withColumn("_corrected", F.lit(None).cast(base.schema["dimensions"].dataType))
    dims = F.coalesce("_corrected", "dimensions")
    startup, founder, engineer = F.lower("company_category").isin(*STARTUP), F.coalesce("founder_history", F.lit(False)), F.coalesce(F.col("title_category") == "software_engineering", F.lit(False))
    startup = F.coalesce(startup, F.lit(False))
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in SENIORITY.items() for x in pair]), F.lower("seniority"))
    known = F.array_except(_labels(F.try_element_at(dims, F.lit("seniority"))), F.array(F.lit("unknown")))
    conflict = level.isNotNull() & (F.size(known) > 0) & (known != F.array(level))
    changed = startup | founder | engineer | level.isNotNull()

    def added(d: Column, *labels: tuple[Column, str]) -> Column:
        new = F.array_compact(F.array(*[F.when(when, label) for when, label in labels]))
        kept = F.array_except(_labels(d), F.array(*map(F.lit, EMPTY_LABELS)))
        return F.when(F.size(new) > 0, _with(d, F.array_sort(F.array_union(kept, new)), F.greatest(d["confidence"], F.lit(CONFIDENCE)))).otherwise(d)

    def dimension(name: Column, d: Column) -> Column:
        only = F.when(founder, F.array(F.lit("founder"))).when(level.isNotNull(), F.array(level))
        return (
            F.when(name == "professional_identity", added(d, (startup, "startup_operator"), (founder, "founder_cofounder"))).when(name == "functional_role", added(d, (engineer, "engineering")))
            .when(name == "builder_evidence", added(d, (founder, "founded_company"))).when((name == "seniority") & only.isNotNull(), _with(d, only, F.lit(CONFIDENCE))).otherwise(d)
        )

    reasons = F.array_compact(F.array(F.when(conflict, "conflicting_evidence"), F.when(founder, "consequential_claim"), F.when(changed & F.col("_corrected").isNotNull(), "prior_human_correction")))
    opened = F.size(reasons) > 0
    return found.select(
        *[c for c in base.columns if c not in ("dimensions", "review_reasons", "review_state", "fingerprint")],
        F.when(changed, F.transform_values(dims, dimension)).otherwise(F.col("dimensions")).alias("dimensions"),
        F.when(opened, F.array_sort(F.array_union(F.coalesce("review_reasons", F.array().cast("array<string>")), reasons))).otherwise(F.col("review_reasons")).alias("review_reasons"),
        F.when(opened, "pending").otherwise(F.col("review_state")).alias("review_state"), F.col("_new").alias("fingerprint"),
    ).select(*base.columns)
