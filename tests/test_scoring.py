"""The recommendation of a model: each step's reason, the order and ties."""

import pytest

from cohortlens.operators import scoring

GOOD = {c: 9000 for c in scoring.MORE_IS_BETTER} | dict.fromkeys(scoring.LESS_IS_BETTER, 10) | {
    "mandatory_review_coverage_basis_points": 10_000, "partner_taxonomy_expected_positive_count": 1, "partner_metric_expected_positive_count": 1, "failed_attempt_count": 0,
    "impressive_expected_positive_count": 1, "impressive_expected_negative_count": 1,
}
SCHEMA = "model string, " + ", ".join(f"{c} long" for c in GOOD)


def chosen(spark, *changes):
    rows = [(f"m{i}", *(GOOD | c).values()) for i, c in enumerate(changes)]
    return tuple(scoring.recommended(spark.createDataFrame(rows, SCHEMA), 9000).first())


@pytest.mark.parametrize("change, reason", [
    ({"mandatory_review_coverage_basis_points": 9_999}, "no_model_met_mandatory_review_coverage"), ({"partner_taxonomy_expected_positive_count": 0}, "no_model_met_partner_taxonomy_gold_support_requirement"),
    ({"partner_metric_expected_positive_count": None}, "no_model_met_partner_metric_gold_support_requirement"), ({"impressive_agreement_basis_points": 8_999}, "no_model_met_impressive_agreement_threshold"),
    ({"report_scalar_agreement_basis_points": 8_999}, "no_model_met_report_scalar_agreement_threshold"), ({"report_scalar_minimum_basis_points": 7_999}, "no_model_met_report_scalar_minimum_floor"),
    ({"partner_metric_precision_basis_points": 8_999}, "no_model_met_partner_metric_precision_threshold"), ({"partner_metric_recall_basis_points": None}, "no_model_met_partner_metric_recall_threshold"),
    ({"partner_taxonomy_precision_basis_points": 8_999}, "no_model_met_partner_taxonomy_precision_threshold"), ({"partner_taxonomy_recall_basis_points": 7_999}, "no_model_met_partner_taxonomy_recall_floor"),
    ({"failed_attempt_count": 1}, "no_model_met_zero_failure_requirement"), ({"impressive_expected_negative_count": 0}, "no_model_met_impressive_gold_class_diversity_requirement"),
    ({"impressive_expected_positive_count": None}, "no_model_met_impressive_gold_class_diversity_requirement"),
])
def test_the_first_step_that_nobody_passes(spark, change, reason):
    assert chosen(spark, change) == (None, reason)


def test_order_ties_and_floors(spark):
    assert chosen(spark, {"cost_usd_micros": 11}, {}) == ("m1", scoring.SELECTED)
    assert chosen(spark, {"report_scalar_agreement_basis_points": 9001, "cost_usd_micros": 99}, {}) == ("m0", scoring.SELECTED)
    assert chosen(spark, {}, {}, {"failed_attempt_count": 1}) == (None, scoring.TIED)
    assert chosen(spark, {"partner_taxonomy_recall_basis_points": 8_000, "report_scalar_minimum_basis_points": 8_000}) == ("m0", scoring.SELECTED)
    # Two models that fail at different steps: the reason is the first step that neither has passed so far.
    assert chosen(spark, {"failed_attempt_count": 1}, {"partner_metric_recall_basis_points": 0}) == (None, "no_model_met_zero_failure_requirement")
    assert tuple(scoring.recommended(spark.createDataFrame([], SCHEMA), 9000).first()) == (None, "no_model_met_mandatory_review_coverage")
