"""Evidence rules by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import evidence as ev
from cohortlens.operators import evidence


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_ladders_take_the_first_category_and_nulls_are_unknown(spark):
    null = F.lit(None).cast("string")
    got = one(
        spark, both=ev.seniority(F.lit("Senior"), F.lit("Co-Founder")), vp=ev.seniority(null, F.lit("VP Sales")), none=ev.seniority(null, null), ctx=ev.seniority_context(null, null),
        baker=ev.seniority_context(null, F.lit("Baker")), industry=ev.industry_code(null), other=ev.industry_code(F.lit("Farming")), company=ev.company_category(null, F.lit("10,001+"), null),
    )
    assert got == {"both": "founder", "vp": "executive", "none": "unknown", "ctx": "unknown", "baker": "individual_contributor", "industry": "unknown", "other": "other", "company": "enterprise"}


@pytest.mark.parametrize("size,band", [("2-10", "small"), ("10+ of 200", "small"), ("1,000", "medium"), ("1001-5000", "large"), ("9" * 40, "enterprise"), ("1", "solo"), ("Self Employed", "solo"), ("x2", "unknown"), (None, "unknown")])
def test_organization_size(spark, size, band):
    assert one(spark, b=ev.organization_size(F.lit(size).cast("string")))["b"] == band


def test_duration_and_tiers(spark):
    year = lambda y: F.lit(y).cast("int")
    got = one(spark, a=ev.duration_band(year(36), year(None), year(None)), b=ev.duration_band(year(None), year(2020), year(2019)), c=ev.duration_band(year(None), year(2020), year(2020)))
    assert got == {"a": "one_to_three_years", "b": "unknown", "c": "under_one_year"}
    project = {k: F.lit(v[0]) for k, v in ev.STANDOUT.items()}
    unknown = dict.fromkeys(project, F.lit("unknown"))
    got = one(
        spark, top=ev.builder_tier(project), second=ev.builder_tier(project | {"external_validation": F.lit("none_observed")}), some=ev.builder_tier(unknown | {"technical_depth": F.lit("basic")}),
        none=ev.builder_tier(unknown | {"external_validation": F.lit("none_observed")}), null=ev.builder_tier(dict.fromkeys(project, F.lit(None).cast("string"))),
    )
    assert got == {"top": "standout", "second": "substantial", "some": "exploratory", "none": "insufficient", "null": "insufficient"}


def test_codes(spark):
    got = one(spark, t=ev.technology_codes(F.lit("AI with Node, C#")), n=ev.technology_codes(F.lit(None).cast("string")), p=ev.topic_codes(F.array(F.lit("RAG"), F.lit("llm"), F.lit("?"), F.lit("data"))), l=ev.language_code(F.lit(None).cast("string")))
    assert got == {"t": ["applied_ai", "dotnet", "javascript_typescript", "web_backend"], "n": [], "p": ["ai_infrastructure", "data"], "l": "unknown"}
    many = one(spark, t=ev.technology_codes(F.lit(" ".join(n[0] for n in ev.TECHNOLOGIES.values()))))["t"]
    assert many == sorted(ev.TECHNOLOGIES)[:12]


def test_a_key_version_without_a_secret_is_an_error(spark):
    rows = spark.createDataFrame([("a@b.c",), (None,)], "email string")
    ghosts = spark.createDataFrame([(1, "v9", "00")], "person_id int, key_version string, identity_hmac string")
    with pytest.raises(Exception, match="no secret for key version v9"):
        evidence.ghost_matches(rows, ghosts, F.col("email"), {"v1": b"x" * 16}).collect()
    kept = evidence.ghost_matches(rows, ghosts.where("false"), F.col("email"), {"v1": b"x" * 16}).collect()
    assert [r["ghost_person"] for r in kept] == [None, None]


def test_owners_of_nothing_but_forks_have_zeros(spark):
    repos = spark.sql("select 1 as owner, true as fork, false as archived, false as disabled, 5 as stars, 6 as forks, 'Go' as language, timestamp_ntz'2024-01-01' as pushed_at")
    row = evidence.repository_rollup(repos, "owner", F.lit("2024-06-01").cast("timestamp_ntz")).first()
    assert (row["owned"], row["stars"], row["forks"], row["recent"], row["technologies"]) == (0, 0, 0, 0, [])
