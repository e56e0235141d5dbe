"""Model scoring and selection in whole basis points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basis_points(n: Column, d: Column) -> Column:
    """Floor division; an empty denominator is a full score."""
    return F.when(d == 0, F.lit(10_000)).otherwise(F.floor(n * 10_000 / d)).cast("long")


def scores(rows: DataFrame) -> DataFrame:
    """By model: ``rows`` has model, expected and predicted (0/1)."""
    hit = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    found = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return found.withColumns({"precision_bp": basis_points(tp, tp + fp), "recall_bp": basis_points(tp, tp + fn), "agreement_bp": basis_points(tp + tn, F.col("n"))})


def selected(scored: DataFrame, cascade: list[tuple[str, Column]], order: list[Column], key: str) -> DataFrame:
    """The best model that passes every step, none where the best two tie; else the first step that nobody passes.

    ``order``: the less the better. A row for each model, so its candidates fit one array.
    """
    passed, steps = F.lit(True), []
    for name, condition in cascade:
        passed = passed & condition
        steps.append((name, passed))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    found = scored.agg(*[F.count_if(c).alias(name) for name, c in steps], F.array_sort(F.collect_list(F.when(passed, F.struct(rank.alias("rank"), F.col(key).alias("key"))))).alias("best"))
    tie = (F.size("best") > 1) & (F.get("best", F.lit(0))["rank"] == F.get("best", F.lit(1))["rank"])
    reason = F.coalesce(F.when(tie, "tie"), *[F.when(F.col(name) == 0, name) for name, _ in steps], F.lit("selected"))
    return found.select(F.when(~tie, F.get("best", F.lit(0))["key"]).alias(key), reason.alias("reason"))


# The steps that a model must pass, as (column, what it is held against, reason where no model passes); the order of those
# that pass, best first; how far below the threshold a floor lies; and the two other reasons.
STEPS = [
    ("mandatory_review_coverage_basis_points", "whole", "no_model_met_mandatory_review_coverage"),
    ("partner_taxonomy_expected_positive_count", "some", "no_model_met_partner_taxonomy_gold_support_requirement"),
    ("partner_metric_expected_positive_count", "some", "no_model_met_partner_metric_gold_support_requirement"),
    ("impressive_agreement_basis_points", "threshold", "no_model_met_impressive_agreement_threshold"),
    ("report_scalar_agreement_basis_points", "threshold", "no_model_met_report_scalar_agreement_threshold"),
    ("report_scalar_minimum_basis_points", "floor", "no_model_met_report_scalar_minimum_floor"),
    ("partner_metric_precision_basis_points", "threshold", "no_model_met_partner_metric_precision_threshold"),
    ("partner_metric_recall_basis_points", "threshold", "no_model_met_partner_metric_recall_threshold"),
    ("partner_taxonomy_precision_basis_points", "threshold", "no_model_met_partner_taxonomy_precision_threshold"),
    ("partner_taxonomy_recall_basis_points", "floor", "no_model_met_partner_taxonomy_recall_floor"),
    ("failed_attempt_count", "none", "no_model_met_zero_failure_requirement"),
    ("impressive_expected_class_count", "some", "no_model_met_impressive_gold_class_diversity_requirement"),
]
MORE_IS_BETTER = [
    "report_scalar_agreement_basis_points", "report_scalar_minimum_basis_points", "partner_metric_precision_basis_points", "partner_metric_recall_basis_points",
    "partner_taxonomy_precision_basis_points", "partner_taxonomy_recall_basis_points", "impressive_agreement_basis_points",
]
LESS_IS_BETTER = ["expected_human_escalation_case_basis_points", "cost_usd_micros"]
FLOOR_ALLOWANCE = 1_000
TIED, SELECTED = "models_tied_on_quality_escalation_and_cost", "proposal_quality_thresholds_met_mandatory_human_review_before_release_ranked_by_quality_then_escalation_then_cost"


def recommended(reports: DataFrame, threshold: int) -> DataFrame:
    """``(model, reason)``: the best of the models that pass every step; no model where none passes or the best two are equal in all that ranks them.

    A null score passes no step; without reports the first step's reason is given.
    """
    held = {"whole": lambda c: c == 10_000, "some": lambda c: c > 0, "none": lambda c: c == 0, "threshold": lambda c: c >= threshold, "floor": lambda c: c >= max(0, threshold - FLOOR_ALLOWANCE)}
    classes = F.least(F.col("impressive_expected_positive_count"), F.col("impressive_expected_negative_count"))
    classes = F.when(F.col("impressive_expected_positive_count").isNotNull() & F.col("impressive_expected_negative_count").isNotNull(), classes)
    scored = reports.withColumn("impressive_expected_class_count", classes)
    cascade = [(reason, F.coalesce(held[how](F.col(c)), F.lit(False))) for c, how, reason in STEPS]
    found = selected(scored, cascade, [-F.col(c) for c in MORE_IS_BETTER] + [F.col(c) for c in LESS_IS_BETTER], "model")
    return found.select("model", F.when(F.col("reason") == "tie", TIED).when(F.col("reason") == "selected", SELECTED).otherwise(F.col("reason")).alias("reason"))
