"""Native string columns: normalisers, keys, rule classifier, formatting. Everything stays inside Catalyst."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The triggers of the rule classifier.
TRIGGERS = {
    "professional_identity": {
        "founder_cofounder": r"co[ -]?founder|founder|founded", "startup_operator": r"startup|scale[ -]?up|ceo|cto|cpo|coo",
    },
    "functional_role": {
        "engineering": r"software|engineer|developer|backend|frontend|full[ -]?stack|devops|cloud", "data_ai": r"ai|machine learning|ml|data scientist|data engineer|analytics",
        "product": r"product manager|product owner|product strategy", "design": r"designer|ux|ui|design", "commercial": r"sales|marketing|growth|business development|partnerships",
        "operations": r"operations|operator|program manager", "research": r"research|scientist|academic|phd",
    },
    "capabilities": {
        "backend": r"backend|api|distributed|python|java|go|rust", "frontend": r"frontend|react|javascript|typescript|web", "ai_ml": r"ai|machine learning|ml|llm|model",
        "data": r"data|analytics|sql", "cloud": r"cloud|aws|gcp|azure|devops|kubernetes", "mobile": r"mobile|ios|android|flutter|react native",
        "product": r"product|discovery|roadmap", "design": r"design|ux|ui", "growth": r"growth|sales|marketing|commercial", "security": r"security|cyber|infosec",
    },
    "domains": {
        "applied_ai": r"ai|machine learning|llm|model", "developer_tools": r"developer tool|devtool|api platform|sdk", "fintech": r"fintech|payment|bank|finance|financial",
        "cybersecurity": r"cyber|security|infosec", "marketplaces": r"marketplace|commerce|ecommerce|retail", "climate": r"climate|energy|sustainab",
        "health": r"health|medical|care|biotech", "education": r"education|school|learning|student", "enterprise": r"enterprise|workflow|b2b|automation",
    },
}
# Further triggers of the classifier, and what counts as a yes.
RESEARCHER = r"researcher|research scientist|professor|phd|academic"
LEADERSHIP = r"chief|head|lead|principal|staff|director|vp|manager"
STUDENT = r"student|undergraduate|master'?s|bachelor'?s"
JUNIOR = r"junior|intern|trainee"
ACADEMIC = r"university|research institute|academy|academic"
SHIPPED = r"shipped|launched|deployed|built|created|users|customers|revenue|production"
TRUE_WORDS = ("yes", "true", "1", "approved", "checked in")


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def email(c: Column) -> Column:
    """Native form of e-mail normalisation: stripped and lower-cased, empty becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def mask_email(c: Column) -> Column:
    """First character, then the part behind the first @."""
    at = F.instr(c, "@")
    return F.when(at > 0, F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substr(c, at + 1))).otherwise(F.lit("***"))


def github(c: Column) -> Column:
    """A handle, from a bare handle or a profile address; null where it can't be one."""
    plain = F.lower(strip(c))
    handle = F.when(plain.rlike(r"^(https?://)?(www\.)?github\.com/"), F.regexp_extract(plain, r"^(?:https?://)?(?:www\.)?github\.com/([^/?#]*)", 1)).otherwise(F.regexp_replace(plain, "^@", ""))
    return F.when(handle.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,38})$"), handle)


def linkedin(c: Column) -> Column:
    """The segment behind /in/ of an address at linkedin.com or below it."""
    found = F.regexp_extract(F.lower(strip(c)), r"^(?:https?://)?(?:[a-z0-9-]+\.)*linkedin\.com/(?:[^?#]*/)?in/([^/?#]+)", 1)
    return F.nullif(found, F.lit(""))


def track(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case words joined by underscores; known aliases replaced; empty is ``unclassified``."""
    key = F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    for a, b in (aliases or {}).items():
        key = F.when(key == a, F.lit(b)).otherwise(key)
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unclassified"))


def team_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def status(c: Column) -> Column:
    key = F.lower(strip(c))
    return F.when(key.isin("approved", "accepted"), "accepted").when(key.isin("declined", "rejected"), "declined").when(key.isin("waitlist", "waitlisted"), "waitlist").otherwise("applied")


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit(False))


def stable_reference(event: Column, kind: Column, strategy: Column, value: Column) -> Column:
    return F.concat_ws("_", kind, F.sha2(event, 256), F.sha2(F.concat_ws("\0", event, kind, strategy, value), 256))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC as two nested hashes; the key's pads become literals of the plan, so treat plans as secret."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def pseudonym(value: Column, secret: bytes, version: str) -> Column:
    return F.concat(F.lit(f"pid:{version}:"), hmac_sha256(F.lower(strip(value)), secret))


def _spelt(alternative: str) -> list[str]:
    """What an alternative of a trigger stands for: optional blanks, hyphens and apostrophes written out."""
    found = [""]
    for part in re.split(r"(\[ -\]\?|'\?)", alternative):
        found = [f + x for f in found for x in ({"[ -]?": ["", " ", "-"], "'?": ["", "'"]}.get(part, [part]))]
    return found


@lru_cache(None)
def trigger(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The single words of a trigger, and its phrases, which hold something else than letters and digits."""
    spelt = sorted({x for a in pattern.split("|") for x in _spelt(a)})
    return tuple(x for x in spelt if x.isalnum()), tuple(x for x in spelt if not x.isalnum())


def _parts(phrase: str) -> list[str]:
    return re.findall("[a-z0-9]+", phrase)


class Words(NamedTuple):
    """A text, and which words of any trigger it has."""

    text: Column
    hits: Column

    def has(self, pattern: str) -> Column:
        """Whether the trigger occurs as whole words. A phrase is looked for only where its words are there."""
        words, phrases = trigger(pattern)
        found = F.arrays_overlap(self.hits, F.array(*map(F.lit, words))) if words else F.lit(False)
        for phrase in phrases:
            near = F.size(F.array_except(F.array(*map(F.lit, _parts(phrase))), self.hits)) == 0
            found |= F.when(near, self.text.rlike(rf"(?U)\b{re.escape(phrase)}\b")).otherwise(False)
        return found


def _all_words() -> list[str]:
    patterns = [p for group in TRIGGERS.values() for p in group.values()] + [RESEARCHER, LEADERSHIP, STUDENT, JUNIOR, ACADEMIC, SHIPPED, "senior|year|years"]
    return sorted({w for p in patterns for side in trigger(p) for x in side for w in _parts(x)})


def word_hits(c: Column) -> Column:
    """The words of a text that occur in any trigger, each once: the text is split once for all of them."""
    return F.array_intersect(F.split(c, r"(?U)\W+"), F.array(*map(F.lit, _all_words())))


def _labels(rules: dict[str, Column], none: str) -> Column:
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in sorted(rules.items())]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none)))


DIMENSIONS = ("professional_identity", "seniority", "functional_role", "employer_pedigree", "builder_evidence", "capabilities", "domains")


def classified(df: DataFrame, occupation: Column, experience: Column, impressive: Column, organization: Column, github_supplied: Column) -> DataFrame:
    """``df`` with seven dimensions of labels; what has no evidence is unknown, never a no. Null texts are empty."""
    given = {"_occupation": occupation, "_experience": experience, "_impressive": impressive, "_organization": organization}
    texts = df.withColumns({k: F.lower(F.coalesce(c, F.lit(""))) for k, c in given.items()} | {"_supplied": github_supplied})
    texts = texts.withColumns({"_text": F.concat_ws(" ", *given), "_made": F.concat_ws(" ", "_experience", "_impressive")})
    sides = ("_text", "_occupation", "_organization", "_made")
    # The hits are columns of their own, so that they are worked out once for all triggers.
    texts = texts.withColumns({f"{k}_hits": word_hits(F.col(k)) for k in sides})
    all_, role, organization_, made = (Words(F.col(k), F.col(f"{k}_hits")) for k in sides)
    founder = all_.has(TRIGGERS["professional_identity"]["founder_cofounder"])
    numbers = F.regexp_extract_all("_text", F.lit(r"(?U)\b(\d{1,2})\+?\s+years?\b"), 1)
    years = F.when(F.arrays_overlap(all_.hits, F.array(F.lit("year"), F.lit("years"))), F.array_max(F.transform(numbers, lambda x: x.cast("int"))))
    seniority = (
        F.when(founder, "founder").when(role.has(LEADERSHIP), "lead_staff_executive").when(role.has("senior"), "senior").when(all_.has(STUDENT), "student")
        .when(all_.has(JUNIOR), "junior").when(years >= 6, "senior").when(years >= 3, "mid_level").when(years.isNotNull(), "junior").otherwise("unknown")
    )
    employer = F.when(founder, "self_employed_founder").when(seniority == "student", "student_no_employer").when(organization_.has(ACADEMIC), "academia_research").otherwise("unknown")
    plain = lambda d, none: _labels({k: all_.has(p) for k, p in TRIGGERS[d].items()}, none)
    identity = {k: all_.has(p) for k, p in TRIGGERS["professional_identity"].items()} | {"researcher_academic": role.has(RESEARCHER)}
    builder = {"founded_company": founder, "shipped_product": made.has(SHIPPED), "github_supplied": F.col("_supplied")}
    found = (
        _labels(identity, "insufficient_evidence"), F.array(seniority), plain("functional_role", "unknown"), F.array(employer), _labels(builder, "insufficient_evidence"), plain("capabilities", "unknown"), plain("domains", "unknown"),
    )
    return texts.select(*df.columns, *[c.alias(k) for k, c in zip(DIMENSIONS, found)])


def count_band(n: Column) -> Column:
    return F.when(n == 0, "none").when(n < 10, "some").when(n < 100, "notable").otherwise("high")


def age_band(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 180, "new").when(days < 1095, "established").otherwise("mature")


def recency_band(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 90, "active_90d").when(days <= 365, "active_365d").otherwise("stale")


def size_band(n: Column) -> Column:
    return F.when(n < 300, "tiny").when(n < 3000, "small").when(n < 30000, "medium").otherwise("large")


def engagement(stars: Column, forks: Column) -> Column:
    return F.least(stars, F.lit(100_000)) * 3 + F.least(forks, F.lit(100_000)) * 5


def recency(days: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.lit(100_000) - days), F.lit(0))


def count_line(n: Column, denominator: Column) -> Column:
    """``n of d (p%)``, halves rounded to even."""
    share = F.bround(n.cast("double") / denominator * 100).cast("long").cast("string")
    return F.concat(n.cast("string"), F.lit(" of "), denominator.cast("string"), F.lit(" ("), F.coalesce(share, F.lit("0")), F.lit("%)"))


def exact_percentage(n: Column, denominator: Column) -> Column:
    return F.regexp_replace(F.format_string("%.6f", n.cast("double") / denominator * 100), r"\.?0+$", "")


def token_cost(tokens: Column, rate: Column) -> Column:
    """Whole micros, rounded up."""
    return F.expr("1") * F.floor((tokens * rate + 999_999) / 1_000_000)


def pii_kind(c: Column) -> Column:
    """The first kind of personal data in a text, or null."""
    return (
        F.when(c.rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+"), "email").when(c.rlike(r"(?i)\bhttps?://|\bwww\."), "url").when(c.rlike(r"\bpid:[a-z0-9]+:[0-9a-f]{64}\b"), "pseudonym")
        .when(c.rlike(r"(?:\d{1,3}\.){3}\d{1,3}"), "address")
    )
