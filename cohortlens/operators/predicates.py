"""Registries as data: a JSON predicate tree (``all``, ``eq``, ``in``) compiled to one Column, so that Catalyst folds it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compiled(tree: dict, column=F.col) -> Column:
    (kind, body), = tree.items()
    if kind == "all":
        return reduce(lambda a, b: a & b, (compiled(t, column) for t in body))
    if kind == "eq":
        return column(body["path"]) == body["value"]
    if kind == "in":
        return column(body["path"]).isin(*body["values"])
    raise ValueError(f"unknown predicate {kind!r}")


def _in(path: str, *values: str) -> dict:
    return {"in": {"path": path, "values": list(values)}}


# The registered metrics and public groups.
METRICS = {
    "advanced_technical_evidence": _in("technical_depth", "advanced", "exceptional"),
    "differentiated_problem": _in("originality", "ambitious", "differentiated"),
    "meaningful_validation": _in("external_validation", "meaningful", "strong"),
    "primary_execution": _in("execution_scope", "end_to_end_builder", "primary_builder"),
    "serious_product_builder": {"all": [_in("builder_level", "standout", "substantial"), _in("product_maturity", "production_evidence", "working_product")]},
    "standout_builder": {"eq": {"path": "builder_level", "value": "standout"}},
    "substantive_technical_evidence": _in("technical_depth", "advanced", "exceptional", "moderate"),
}
METRIC_RELATIONS = [("substantive_technical_evidence", "advanced_technical_evidence")]
GROUPS = {
    "advanced_or_exceptional_technical": ("technical_depth", ["advanced", "exceptional"]),
    "differentiated_or_ambitious_problem": ("problem_differentiation", ["ambitious", "differentiated"]),
    "early_or_greater_validation": ("external_validation", ["early_signal", "meaningful", "strong"]),
    "meaningful_or_strong_validation": ("external_validation", ["meaningful", "strong"]),
    "moderate_or_stronger_technical": ("technical_depth", ["advanced", "exceptional", "moderate"]),
    "prototype_or_beyond": ("product_maturity", ["production_evidence", "prototype", "working_product"]),
    "substantial_or_greater_execution": ("execution_scope", ["end_to_end_builder", "primary_builder", "substantial_contributor"]),
    "working_or_production": ("product_maturity", ["production_evidence", "working_product"]),
}
GROUP_RELATIONS = [
    ("early_or_greater_validation", "meaningful_or_strong_validation"), ("moderate_or_stronger_technical", "advanced_or_exceptional_technical"), ("prototype_or_beyond", "working_or_production"),
]
# States of an assessment, nested cohorts widest first, overlapping signals and their exact regions.
STATES = ["assessed", "no_evidence", "provider_unavailable", "conflict", "rejected", "excluded"]
COHORTS = ["all", "accepted", "attended"]
SIGNALS = ["founder_evidence", "technical_function", "shipped_product_evidence"]
REGIONS = {
    "founder_technical_shipped_product_exact": (True, True, True), "founder_technical_exact": (True, True, False), "founder_shipped_product_exact": (True, False, True),
    "founder_only_exact": (True, False, False), "technical_shipped_product_exact": (False, True, True), "technical_only_exact": (False, True, False),
    "shipped_product_only_exact": (False, False, True), "neither_recorded_exact": (False, False, False),
}
