"""Text functions that Spark has no built-in for: pandas UDFs, and a plain one where texts are whole pages."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = frozenset(["script", "style", "noscript", "svg"])
#: The reference's excerpt of a page.
EXCERPT_CHARS = 4000
#: Comments, and elements whose content isn't parsed; one that never ends goes on to the end.
_UNPARSED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag: its slash, its name, and the rest; a value in quotes may hold >, a quote without its second is a character like others.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])((?>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*))>""")


@F.pandas_udf(StringType())
def casefold_nfkc(c: pd.Series) -> pd.Series:
    """NFKC, stripped, casefolded; empty becomes null."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold() or None)


def visible_whole(html: str | None) -> str | None:
    """The words outside comments and hidden elements of the whole page, character references decoded, joined by spaces."""
    if html is None:
        return None
    pieces = _TAG.split(_UNPARSED.sub(" ", html))  # text, then for each tag its slash, its name, the rest and the text behind it
    words, hidden = unescape(pieces[0]).split(), 0
    for slash, name, rest, text in zip(pieces[1::4], pieces[2::4], pieces[3::4], pieces[4::4]):
        if name and name.lower() in SKIPPED and (slash or not rest.endswith("/")):
            hidden = max(0, hidden - 1) if slash else hidden + 1
        if not hidden:
            words += unescape(text).split()
    return " ".join(words)


def visible(html: str | None) -> str | None:
    """The reference's excerpt, the beginning of ``visible_whole``; no query takes it."""
    text = visible_whole(html)
    return text and text[:EXCERPT_CHARS]


#: Rows reach Python a hundred at a time: an Arrow batch would be thousands of pages, whatever their length.
visible_text = F.udf(visible_whole, StringType(), useArrow=False)
