"""Which direct identifier a text holds first, and texts with all of them taken out.

Both scan a text with one ordered table of patterns. Beside each pattern stands what a text must hold for it to match at all, so that
most patterns are settled by a search for a few letters; what is removed leaves a space behind, so a word that a text doesn't
hold at first never comes about later.

Defined results: null stays null; texts of any length are read whole; an empty text holds no identifier.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EXCERPT_CHARS, MOST_CHARS = 2_000, 12_000
INITIAL = "subject-initial:"


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    #: Of these words (casefolded) or this pattern a text must hold one; without both any text may match.
    words: tuple[str, ...] = ()
    hint: re.Pattern | None = None

    def possible(self, text: str, folded: str) -> bool:
        return not (self.words or self.hint) or any(w in folded for w in self.words) or bool(self.hint and self.hint.search(text))


def _rule(label: str, pattern: str, words: str = "", hint: str | None = None) -> Rule:
    return Rule(label, re.compile(pattern), tuple(words.split()), hint and re.compile(hint))


# Patterns, top-level domains, places and words that decide what is an identifier.
TOP_LEVEL = (
    "academy|agency|ai|app|art|biz|blog|cloud|club|co|com|community|company|design|dev|digital|email|eu|finance|health|info|io|live|"
    "market|me|net|network|news|online|org|pl|site|solutions|store|studio|systems|team|tech|tools|world|xyz"
)
PLACES = (
    r"amsterdam|austria|barcelona|belgium|berlin|bratislava|brussels|budapest|copenhagen|czech(?:ia|\s+republic)|dublin|europe|finland|"
    r"france|gdansk|gdańsk|germany|greece|helsinki|ireland|italy|krak(?:ow|ów)|lisbon|london|madrid|munich|münchen|netherlands|new\s+york|norway|paris|"
    r"poland|polska|porto|prague|riga|rome|spain|stockholm|sweden|switzerland|tallinn|ukraine|united\s+kingdom|united\s+states|"
    r"vienna|vilnius|warsaw|warszawa|wroclaw|wrocław|zurich"
)
CONTROL = _rule("control_character", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
HEADING = _rule("markdown_heading", r"(?m)^[ \t]{0,3}#{1,6}[ \t]*", "#")
LABELED = _rule("labeled_identifier", r"(?i)\b(?:github|linkedin|login|owner|profile|repo(?:sitory)?|user(?:name)?|source[_-]?(?:id|ref)|subject[_-]?(?:id|ref))\s*[:=]\s*['\"]?[A-Za-z0-9][A-Za-z0-9_.:/-]{2,255}['\"]?", ": =")
STABLE = _rule(
    "stable_identifier",
    r"(?i)\b(?:pid:v[0-9]+:[a-z0-9_-]{8,}|(?:applicant|candidate|person|source|subject)[_:-](?=[a-z0-9_-]{3,}\b)(?=[a-z0-9_-]*[0-9])[a-z0-9_-]{3,}|(?:cs|gh|li)_[a-z0-9_-]{6,}|[a-f0-9]{32,})\b",
    "pid:v applicant candidate person source subject cs_ gh_ li_", "[a-fA-F0-9]{32}",
)
EMAIL = _rule("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "@")
SPELT_EMAIL = _rule("email", r"(?i)(?<![\w@])[a-z0-9._%+-]{2,}\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\s+at\s+)\s*[a-z0-9-]*(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\s+dot\s+)\s*[a-z0-9-]+)+\b", "dot")
ADDRESS = _rule("url", r"(?i)(?:https?://|www\.)\s*\S*", "http www.")
DOMAIN = _rule("bare_domain", r"(?i)(?<![@\w])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?::[0-9]{2,5})?(?:/[^\s]*)?", hint=r"(?i)\.(?<=[a-z0-9]\.)[a-z]{2}")
SPACED_DOMAIN = _rule("bare_domain", rf"(?i)(?<![@\w])(?:[a-z0-9-]+\s*)?(?:\.\s*[a-z0-9-]{{2,}}\s*)*\.\s*(?:{TOP_LEVEL})\b", hint=rf"(?i)\.\s*(?:{TOP_LEVEL})\b")
ANY_DOMAIN = _rule("bare_domain", r"(?i)(?<![@\w])[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\s+\.\s*[a-z]{2,63}\b", hint=r"(?i)\.(?<=\s\.)\s*[a-z]{2}")
SPELT_DOMAIN = _rule("bare_domain", r"(?i)(?<![@\w])[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\s+(?:dot|\[\s*dot\s*\]|\(\s*dot\s*\))\s+[a-z]{2,63}\b", "dot")
REPOSITORY = _rule("repository_path", r"(?i)(?:\brepo(?:sitory)?\s*:\s*['\"]?/?|(?<![\w./-])/)[a-z0-9][a-z0-9_.-]{1,38}/[a-z0-9][a-z0-9_.-]{1,99}(?![\w./-])['\"]?", "/")
BARE_REPOSITORY = _rule("repository_path", r"(?i)(?<![\w./-])/?[a-z0-9][a-z0-9_.-]{0,38}/[a-z0-9][a-z0-9_.-]{0,99}(?![\w./-])", "/")
ORPHAN_SLASH = _rule("repository_path", r"(?i)(?<![\w./-])/(?:\s*/\s*)?[a-z0-9][a-z0-9_.-]{1,99}(?![\w./-])", "/")
LOWER_CAMEL = _rule("product_identifier", r"\b(?!(?:eBPF|eSIM|gRPC|iOS|iPadOS|mDNS|mTLS|macOS|tvOS|useState|watchOS)\b)[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*\b", hint="[A-Z](?<=[a-z0-9][A-Z])")
CHANNEL = _rule("channel_identifier", r"\b[A-Z][A-Za-z0-9'&+-]*(?:\s+(?:is|of|the|and|[A-Z][A-Za-z0-9'&+-]*)){0,4}\s+(?:YT|YouTube(?:\s+Channel)?)\b", hint="Y(?:T|ouTube)")
HANDLE = _rule("handle", r"(?<!\w)@[A-Za-z0-9_-]{2,}", "@")
SPACED_HANDLE = _rule("handle", r"(?<!\w)@\s+[A-Za-z0-9_-]{2,}", "@")
STREET = _rule(
    "location_or_address",
    r"(?i)\b\d{1,6}(?:\s+[^\W\d_][\w'-]*){1,5}\s+(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|way|square|sq|place|pl|ulica|ul|aleja|al)\b"
    r"(?:\s*,\s*(?:(?!and\b|but\b)[^\W\d_][\w'-]*)(?:\s+(?!and\b|but\b)[^\W\d_][\w'-]*){0,2})?", hint=r"\d\s",
)
_LIVES = r"(?i)\b(?:lives?|living|resides?|located|based)\s+(?:in|at|near)"
LOCATION = _rule("location_or_address", _LIVES + r"\s+[^,.;\n]{1,80}?(?=\s+(?:and|but)\b|[,.;\n]|$)", "liv resid locat based")
EMPTY_LOCATION = _rule("location_or_address", _LIVES + r"\s*(?=(?:and|but)\b|[,.;\n]|$)", "liv resid locat based")
ORGANIZATION = _rule(
    "organization",
    r"(?i)\b(?!(?:am|are|be|been|being|is|remain|remains|seem|seems|was|were)\s+)[^\W\d_][\w&'-]*\s+(?:company|corp(?:oration)?|foundation|gmbh|inc(?:orporated)?|labs?|llc|ltd|limited|studio|technologies|ventures)\b",
    "company corp foundation gmbh inc lab llc ltd limited studio technologies ventures",
)
SERVICE = _rule("organization", r"(?i)\b(?:coresignal|github|linkedin|openai)\b", "coresignal github linkedin openai")
EMPTY_PLACE = _rule("location_or_address", r"(?i)\b(?:in|at|near|from)\s*(?=(?:and|but|for|to)\b|[,.;:\n]|$)")
PLACE = _rule("location_or_address", rf"(?i)\b(?:in|at|near|from)\s+(?:the\s+)?(?:{PLACES})\b", re.sub(r"\\s\+\w+|\(.*?\)", "", PLACES).replace("|", " "))
PHONE = _rule("phone", r"(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)", hint=r"\d[\d\s().-]{7}")
NAMED_SECRET = _rule("named_secret", r"(?i)\b(?:api[_-]?key|access[_-]?token|token|secret|password)\s*[:=]\s*[A-Za-z0-9_./+\-=]{12,}\b", ": =")
TOKEN = _rule("token", r"(?i)\b(?:gh[pousr]_|sk-(?:proj-)?)[A-Za-z0-9_-]{16,}\b", "ghp_ gho_ ghu_ ghs_ ghr_ sk-")
PERSON_CUE = re.compile(
    r"\b(?P<cue>alongside|by|mentored\s+by|worked\s+with|with)\s+(?P<first>[a-z][a-z'-]*)\s+[a-z][a-z'-]*(?:\s+(?!(?:and|at|but|for|on|to|who)\b)[a-z][a-z'-]*)?"
    r"(?=\s+(?:and|at|but|for|on|to|who)\b|\s*[,.;:\n]|\s*$)"
)
PROPER_NOUN = re.compile(r"(?<![\w@])[^\W\d_][\w&+-]{2,}(?!\w)")
IMAGE, LINK, TAG = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\]]+)\]\([^)]*\)"), re.compile(r"<[^>]{1,500}>")
GAP, SPACE = re.compile(r"\s+\.\s+"), re.compile(r"\s+")
#: Of proper nouns only those may be one that don't begin with a-z; one behind these signs may be the end of a longer word that does.
CAPITALISED, JOINED = re.compile(r"(?<![\w@])[^\W\d_a-z][\w&+-]{2,}(?!\w)"), re.compile(r"[&+-][^\W\d_a-z]")
#: A dot between white space, found by the dot.
LONE_DOT = re.compile(r"\.(?<=\s\.)\s")
OPENERS = frozenset(
    """Architect Architected Architecture Built Changed Chief Created Currently Data Delivered Deployed Designed Developed Developer Director Documentation
    Engineer Engineering Founder Founded Head Implemented Includes Junior Launched Lead Led Machine Managed Manager Multiple OAuth Operations Previously Product
    Production Repeated Researcher Runs Senior Shipped Software Scientist Supports Technical That The This Uses Worked Working""".split()
)
PLAIN_WORDS = frozenset(
    """api architecture built cloud data deployed deployment designed developed developer engineering implemented infrastructure machine managed mobile operations
    platform product production project prototype research service shipped software system systems tool tooling web workflow workflows working""".split()
)
FIRST_NAMES = frozenset(
    """adam alex anna david ewa jakub james jane jan john julia kamil karolina katarzyna lukasz maria marta mateusz michael michal natalia pawel peter
    piotr robert sarah sofia tomasz wojciech zaneta""".split()
)
#: In the order in which a text's first identifier is looked for.
MARKERS = (
    LABELED, STABLE, EMAIL, SPELT_EMAIL, ADDRESS, DOMAIN, SPACED_DOMAIN, ANY_DOMAIN, SPELT_DOMAIN, REPOSITORY, BARE_REPOSITORY, ORPHAN_SLASH, LOWER_CAMEL, CHANNEL, HEADING,
    HANDLE, SPACED_HANDLE, STREET, LOCATION, ORGANIZATION, SERVICE, EMPTY_PLACE, PLACE, PHONE, NAMED_SECRET, TOKEN, CONTROL,
)
#: In the order in which identifiers are taken out.
REMOVED = (
    LABELED, STABLE, EMAIL, SPELT_EMAIL, ADDRESS, DOMAIN, SPACED_DOMAIN, ANY_DOMAIN, SPELT_DOMAIN, REPOSITORY, BARE_REPOSITORY, ORPHAN_SLASH, LOWER_CAMEL, CHANNEL,
    HANDLE, SPACED_HANDLE, STREET, EMPTY_LOCATION, LOCATION, ORGANIZATION, SERVICE, EMPTY_PLACE, PLACE, PHONE, NAMED_SECRET, TOKEN,
)
#: The versioned variants that an import of older texts may take out.
LEGACY = (HEADING, SPACED_DOMAIN, ANY_DOMAIN, SPELT_EMAIL, SPELT_DOMAIN, REPOSITORY, BARE_REPOSITORY, ORPHAN_SLASH, LOWER_CAMEL, EMPTY_LOCATION, LOCATION, EMPTY_PLACE, PLACE)
# End of the fixed values.


def _folded(text: str) -> str:
    # A pattern that ignores case takes the dotless i for an i, which casefold() doesn't.
    return text.casefold().replace("ı", "i")


def _named(cue: re.Match) -> bool:
    return cue["cue"] != "with" or cue["first"] in FIRST_NAMES


def _proper(word: str) -> bool:
    return word[0].isupper() and word not in OPENERS


def _capitalised(text: str) -> re.Pattern:
    """A pattern that finds all proper nouns of the text, and few other words where it may."""
    return PROPER_NOUN if JOINED.search(text) else CAPITALISED


def bare_person(text: str) -> bool:
    """Two or three words alone, the first a likely first name and none a plain word of the trade."""
    words = text.split()
    return 2 <= len(words) <= 3 and all(re.fullmatch(r"[^\W\d_][\w'-]*", w) for w in words) and words[0].casefold() in FIRST_NAMES and PLAIN_WORDS.isdisjoint(w.casefold() for w in words)


def marker(text: str | None) -> str | None:
    """The label of the first identifier, in the order of the table."""
    if not text:
        return None
    folded = _folded(text)
    for rule in MARKERS:
        if rule.possible(text, folded) and rule.pattern.search(text):
            return rule.label
    if "@" in text:
        return "at_sign"
    if any(map(_named, PERSON_CUE.finditer(text))) or bare_person(text):
        return "possible_person"
    return "proper_noun" if any(_proper(m[0]) for m in _capitalised(text).finditer(text)) else None


def _without_gaps(text: str) -> str:
    return GAP.sub(" ", text) if LONE_DOT.search(text) else text


def _without_proper(text: str) -> str:
    return _capitalised(text).sub(lambda m: " " if _proper(m[0]) else m[0], text)


def _swept(text: str, rules: tuple[Rule, ...], proper: bool | None = None) -> str:
    """Every match of the rules replaced by a space; then names behind cues, and proper nouns, where asked for."""
    folded = _folded(text)
    for rule in rules:
        if rule.possible(text, folded):
            text = rule.pattern.sub(" ", text)
    if proper is None:
        return text
    if "by" in text or "with" in text or "alongside" in text:
        text = PERSON_CUE.sub(lambda m: " " if _named(m) else m[0], text)
    return _without_proper(text) if proper else text


@lru_cache(4096)
def literal_pattern(literal: str) -> re.Pattern | None:
    """What a known literal looks like: its words with anything but letters and digits between; an initial behind a by-line's cue alone."""
    literal = unicodedata.normalize("NFC", literal).strip()
    if literal.startswith(INITIAL):
        initial = literal[len(INITIAL):]
        if len(initial) != 1 or not initial.isalpha():
            raise ValueError("a subject's initial is one letter")
        return re.compile(rf"(?i)(?<!\w)(?:by|author|owner|maintainer)\s*[:=]?\s*{re.escape(initial)}(?=\s*(?:[,.;:)\]}}]|$))")
    words = re.findall(r"[^\W_]+", literal)
    return re.compile(r"(?i)(?<![^\W_])" + r"[\W_]+".join(map(re.escape, words)) + r"(?![^\W_])") if words else None


def _at(text: str, i: int) -> bool:
    return text[i].isalnum() or text[i] in "_&+-"


def sanitised(text: str | None, literals: Iterable[str] = (), max_chars: int = EXCERPT_CHARS) -> str | None:
    """Prose of at most ``max_chars`` without identifiers; empty where one is left."""
    if not 1 <= max_chars <= MOST_CHARS:
        raise ValueError(f"max_chars is from 1 to {MOST_CHARS}")
    if text is None:
        return None
    text = CONTROL.pattern.sub(" ", unicodedata.normalize("NFC", text))
    text = LINK.sub(r"\1", IMAGE.sub(" ", text))
    text = TAG.sub(" ", HEADING.pattern.sub(" ", text))
    for pattern in map(literal_pattern, literals):
        if pattern:
            text = pattern.sub(" ", text)
    text = _without_gaps(_swept(text, REMOVED, True))
    # Words that went may have brought others together.
    text = _without_gaps(_swept(text, REMOVED, False).replace("@", " "))
    text = SPACE.sub(" ", text).strip()
    if bare_person(text):
        return ""
    kept = text[:max_chars]
    if len(text) > max_chars and _at(kept, -1) and _at(text, max_chars) and marker(kept):
        kept = kept[:max(0, kept.rfind(" "))]
    kept = _swept(_without_gaps(kept.rstrip()), REMOVED, True)
    kept = SPACE.sub(" ", kept).strip()
    return "" if marker(kept) else kept


def without_repositories(text: str | None) -> str | None:
    """The text without slash-form repository names, all else as it was."""
    return text if text is None else REPOSITORY.pattern.sub(" ", text)


def without_legacy(text: str | None, rounds: int = 3) -> str | None:
    """The text without the older variants, gone over until nothing changes, three times at most."""
    if text is None:
        return None
    for _ in range(rounds):
        before, text = text, _without_gaps(_swept(text, LEGACY))
        if text == before:
            break
    return SPACE.sub(" ", text).strip()


def _mapped(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def column(c: pd.Series) -> pd.Series:
        return c.map(f, na_action="ignore").astype(object).where(c.notna(), None)

    return column


marker_of, without_repositories_of, without_legacy_of = map(_mapped, (marker, without_repositories, without_legacy))


def sanitised_of(text: Column, literals: Column | None = None, max_chars: int = EXCERPT_CHARS) -> Column:
    """The sanitised text; ``literals`` is an array of what is known to identify the row's subject."""

    @F.pandas_udf(StringType())
    def alone(c: pd.Series) -> pd.Series:
        return c.map(lambda x: sanitised(x, (), max_chars))

    @F.pandas_udf(StringType())
    def known(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([sanitised(x, [] if y is None else [v for v in y if v is not None], max_chars) for x, y in zip(c, k)], dtype=object)

    return alone(text) if literals is None else known(text, literals)
