"""Codes, ladders and bands that evidence is reduced to. Native; what isn't known stays unknown, and case is folded by lower()."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.text import hmac_sha256, strip

# Needles in a padded, lower-cased technology list, by code.
TECHNOLOGIES = {
    "android": ["android"], "applied_ai": ["openai", "artificial intelligence", " ai "], "blockchain": ["blockchain", "solidity", "web3"], "cloud": ["aws", "azure", "gcp"],
    "data": ["pandas", "data science"], "databases": ["postgres", "mongodb", "sql"], "devops": ["docker", "kubernetes", "terraform"], "dotnet": [".net", "c#"], "go": ["golang"], "ios": ["ios"],
    "javascript_typescript": ["javascript", "typescript", "react", "node", "next.js"], "jvm": ["java", "kotlin"], "llm": ["llm", "openai", "gpt"],
    "machine_learning": ["machine learning", "pytorch", "tensorflow"], "mobile": ["flutter", "react native"], "no_code": ["bubble", "no-code"], "php": ["php"], "python": ["python"],
    "robotics": ["robot"], "ruby": ["ruby"], "rust": ["rust"], "shell": ["bash", "shell"], "speech": ["speech", "voice"], "swift": ["swift"], "web": ["web", "react", "next.js"],
    "web_backend": ["django", "fastapi", "express", "node"], "web_frontend": ["react", "vue", "angular", "next.js"],
}
TECHNOLOGY_CODES = 12  # at most, of the sorted codes
# Repository languages.
LANGUAGES = {
    "c": "systems", "c++": "systems", "c#": "dotnet", "css": "web_frontend", "dart": "dart", "f#": "dotnet", "go": "go", "html": "web_frontend", "java": "jvm", "javascript": "javascript_typescript",
    "jupyter notebook": "data_notebook", "kotlin": "jvm", "php": "php", "python": "python", "ruby": "ruby", "rust": "rust", "shell": "shell", "svelte": "web_frontend", "swift": "swift",
    "typescript": "javascript_typescript", "vue": "web_frontend",
}
# Repository topics.
TOPICS = {
    "ai": "applied_ai", "artificial-intelligence": "applied_ai", "machine-learning": "applied_ai", "deep-learning": "applied_ai", "llm": "ai_infrastructure", "large-language-models": "ai_infrastructure",
    "agents": "ai_infrastructure", "rag": "ai_infrastructure", "developer-tools": "developer_tools", "devtools": "developer_tools", "mcp": "developer_tools", "cli": "developer_tools",
    "education": "education", "edtech": "education", "fintech": "fintech", "payments": "fintech", "health": "health", "healthcare": "health", "climate": "climate", "climate-tech": "climate",
    "security": "security", "cybersecurity": "security", "data": "data", "analytics": "data", "web": "web", "webapp": "web", "mobile": "mobile", "marketplace": "marketplace",
}
# Ladders of (category, needles), of which the first that occurs counts.
SENIORITY = [
    ("founder", ["founder", "co-founder", "cofounder"]), ("executive", ["chief", "c-suite", "c suite", "vice president", "vp ", "executive"]), ("principal", ["principal"]), ("staff", ["staff"]),
    ("director", ["director"]), ("head", ["head"]), ("lead", ["lead", "manager"]), ("senior", ["senior"]), ("junior", ["junior", "entry"]), ("mid", ["mid"]),
]
COMPANY = [
    ("academia_research", ["university", "education", "research", "academic"]), ("venture_backed_startup", ["venture backed", "venture-backed"]), ("scaleup", ["scaleup", "scale-up"]),
    ("startup", ["startup", "start-up"]), ("enterprise", ["public company", "10,001+", "5001-10,000"]),
]
CONTEXT = [
    ("founder_executive", ["founder", "co-founder", "chief", "c-suite", "vice president", "vp "]), ("leadership", ["director", "head", "lead", "manager"]),
    ("senior", ["principal", "staff", "senior"]), ("early_career", ["junior", "intern", "trainee", "entry"]),
]
INDUSTRY = [
    ("software", ["software", "technology", "internet", "computer"]), ("finance", ["financial", "bank", "fintech", "insurance"]), ("education", ["education", "university", "school"]),
    ("health", ["health", "medical", "biotech"]), ("research", ["research", "laboratory", "academic"]), ("consulting", ["consult", "professional services"]),
    ("manufacturing", ["manufactur", "industrial", "automotive"]),
]
ORGANIZATION = [("small", 200), ("medium", 1_000), ("large", 5_000)]
# What each tier of a builder asks of a project.
STANDOUT = {
    "product_maturity": ["working_product", "production_evidence"], "technical_depth": ["advanced", "exceptional"], "execution_scope": ["primary_builder", "end_to_end_builder"],
    "external_validation": ["meaningful", "strong"], "problem_differentiation": ["differentiated", "ambitious"],
}
SUBSTANTIAL = {
    "product_maturity": ["working_product", "production_evidence"], "technical_depth": ["moderate", "advanced", "exceptional"],
    "execution_scope": ["substantial_contributor", "primary_builder", "end_to_end_builder"],
}
# Cells that claim nothing, besides unknown.
NEGATIVE = {"external_validation": "none_observed", "founder_state": "no_founder_evidence"}
# Labels that aren't the code with its underscores as spaces.
LABELS = {
    "applied_ai_ml": "Applied AI / ML", "blockchain_web3": "Blockchain / Web3", "data_ai": "Data and AI", "data_ai_engineering": "Data and AI engineering", "go_to_market": "Go-to-market",
    "hardware_iot": "Hardware / IoT", "healthcare_life_sciences": "Healthcare and life sciences", "infrastructure_devops": "Infrastructure / DevOps", "mobile_native": "Native mobile",
    "open_source_maintenance": "Open-source maintenance", "web_full_stack": "Full-stack web",
}


def _text(*parts: Column) -> Column:
    """The parts in lower case, joined by one space; a null part is empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _any(text: Column, needles: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def ladder(text: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The first category of which a needle occurs in ``text``."""
    return F.coalesce(*[F.when(_any(text, needles), category) for category, needles in rules], otherwise)


def mapped(values: dict[str, str], key: Column) -> Column:
    """The value under ``key``, null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def short_code(prefix: str, value: Column, secret: bytes) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(hmac_sha256(value, secret), 1, 24))


def case_reference(external_id: Column, secret: bytes) -> Column:
    if len(secret) < 16:
        raise ValueError("a case reference needs a secret of 16 bytes or more")
    return F.concat(F.lit("case:v1:"), hmac_sha256(F.concat(F.lit("rich:"), strip(external_id)), secret))


def technology_codes(value: Column) -> Column:
    padded = F.concat(F.lit(" "), _text(value), F.lit(" "))
    found = F.array(*[F.when(_any(padded, needles), code) for code, needles in sorted(TECHNOLOGIES.items())])
    return F.slice(F.array_compact(found), 1, TECHNOLOGY_CODES)


def language_code(value: Column) -> Column:
    return F.coalesce(mapped(LANGUAGES, F.lower(value)), F.lit("unknown"))


def topic_codes(topics: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(topics, lambda t: mapped(TOPICS, F.lower(t))))))


def release_signal(releases: Column) -> Column:
    """``releases``: how many are known, null if they weren't asked for."""
    return F.when(releases.isNull(), "unknown").when(releases > 0, "release_observed").otherwise("none_observed")


def deployment_signal(deployments: Column, homepage: Column, pages: Column) -> Column:
    home = (F.coalesce(homepage, F.lit("")) != "") | F.coalesce(pages, F.lit(False))
    return F.when(deployments > 0, "deployment_observed").when(home, "repository_homepage").when(deployments.isNull(), "unknown").otherwise("none_observed")


def seniority(management: Column, title: Column) -> Column:
    return ladder(_text(management, title), SENIORITY, F.lit("unknown"))


def company_category(kind: Column, size: Column, industry: Column) -> Column:
    return ladder(_text(kind, size, industry), COMPANY, F.lit("unknown"))


def seniority_context(management: Column, title: Column) -> Column:
    text = _text(management, title)
    return ladder(text, CONTEXT, F.when(text == " ", "unknown").otherwise("individual_contributor"))


def industry_code(value: Column) -> Column:
    text = _text(value)
    return F.when(text == "", "unknown").otherwise(ladder(text, INDUSTRY, F.lit("other")))


def organization_size(value: Column) -> Column:
    """By the largest whole number in the text; numbers of any length are compared."""
    text = F.replace(_text(value), F.lit(","), F.lit(""))
    numbers = F.filter(F.split(F.translate(text, "+-", "  "), r"\s+"), lambda t: t.rlike("^[0-9]+$"))
    most = F.array_max(F.transform(numbers, lambda t: F.coalesce(t.try_cast("long"), F.lit(2**62))))
    band = F.coalesce(*[F.when(most <= top, name) for name, top in ORGANIZATION], F.lit("enterprise"))
    return F.when(_any(text, ["self-employed", "self employed"]) | (F.trim(text) == "1"), "solo").when(most.isNull(), "unknown").otherwise(band)


def duration_band(months: Column, start_year: Column, end_year: Column) -> Column:
    whole = F.coalesce(months, F.when(end_year >= start_year, (end_year - start_year) * 12))
    return F.when(whole.isNull(), "unknown").when(whole < 12, "under_one_year").when(whole <= 36, "one_to_three_years").otherwise("over_three_years")


def builder_tier(project: dict[str, Column]) -> Column:
    """From a project's dimensions alone; those of the tiers must be among them."""
    meets = lambda wanted: reduce(and_, [F.coalesce(project[d].isin(values), F.lit(False)) for d, values in wanted.items()])
    observed = reduce(or_, [F.coalesce(~c.isin("unknown", *NEGATIVE.values()), F.lit(False)) for c in project.values()])
    return F.when(meets(STANDOUT), "standout").when(meets(SUBSTANTIAL), "substantial").when(observed, "exploratory").otherwise("insufficient")


def public_label(code: Column) -> Column:
    words = F.translate(code, "_", " ")
    return F.coalesce(mapped(LABELS, code), F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2)))))
