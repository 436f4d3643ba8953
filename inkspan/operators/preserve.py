"""What a rewrite of a Markdown document must keep literally: eleven checks, each with its code.

Each pair is judged inside its row, by lists of what both sides hold: nothing is shuffled, rows of one pair_id are each judged,
a null side is the empty text, texts of any length are read whole, and no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Literal Markdown, addresses, figures, quotations, bylines, paths, headings; referrers that a rewrite may drop
FRONTMATTER = r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)"
FENCED = r"(?ms)^`{3,}[^\n]*\n.*?^`{3,}[ \t]*$|^~{3,}[^\n]*\n.*?^~{3,}[ \t]*$"
INLINE = r"`[^`\n]+`"
BLOCKQUOTE = r"(?m)^(?:[ \t]{0,3}>[^\n]*(?:\n|\z))+"
TABLE = r"(?m)^(?:[ \t]*\|[^\n]*\|[ \t]*(?:\n|\z)){2,}"
URL = r"(?i)(?:https?|ftp)://[^\s<>]+|\bwww\.[^\s<>]+"
NUMBER = r"\b\d+(?:\.\d+)?\b%?"
QUOTATION = r'"[^"\n]+"|“[^”\n]+”'
BYLINE = r"(?im)^[ \t]*(?:by|author|written by):?[ \t]+[A-Z][^\n.]+"
_TOKEN = "[A-Za-z0-9._-]+"
PATH = rf"(?i)(?:^|[^A-Za-z0-9_.:/-])([A-Za-z]:[\\/](?:{_TOKEN}[\\/])*{_TOKEN}|~/(?:{_TOKEN}/)*{_TOKEN}|/(?:{_TOKEN}/)*{_TOKEN}|\.\.?/|(?:{_TOKEN}/)+{_TOKEN})"
NO_PATH = r"(?i)^(?:and|or|either)/"
HEADING = r"(?m)^#{1,6}[ \t]+([^\n]+)$"
REFERRER = r"(?i)([?&])(?:utm_source|ref|source)=(?:chatgpt|chatgpt\.com|openai|claude|perplexity)(?:&|(#)|$)"
PROTECTED = "|".join(p.replace("(?ms)", "").replace("(?m)", "").replace("(?s)", "") for p in (FENCED, INLINE, BLOCKQUOTE, TABLE))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normal_url(url: Column) -> Column:
    """An address without the marks that end a sentence and without parameters that name an assistant as its referrer."""
    bare = F.regexp_replace(url, r"[.,;:!?]+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, REFERRER, "$1$2"), REFERRER, "$1$2"), r"[?&]+(#|$)", "$1")


def prose(text: Column) -> Column:
    """Front matter, code, block quotes and tables blanked."""
    return T.masked(T.masked(text, FRONTMATTER, ("---",)), f"(?ms){PROTECTED}", ("`", "~~~", ">", "|"))


def _trimmed(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, r"[\r\n]+$", ""))


#: By code: what a side holds, and whether its order counts.
CHECKS: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "frontmatter-modified": (lambda t: _trimmed(_all(t, FRONTMATTER)), True),
    "code-block-modified": (lambda t: _trimmed(_all(t, FENCED)), True),
    "blockquote-modified": (lambda t: _trimmed(_all(t, BLOCKQUOTE)), True),
    "inline-code-modified": (lambda t: _all(t, INLINE), True),
    "table-modified": (lambda t: _trimmed(_all(t, TABLE)), True),
    "url-modified": (lambda t: F.transform(_all(t, URL), normal_url), False),
    "numeric-literal-modified": (lambda t: _all(prose(t), NUMBER), False),
    "quotation-modified": (lambda t: _all(prose(t), QUOTATION), False),
    "attribution-modified": (lambda t: F.transform(_all(t, BYLINE), lambda v: F.btrim(v, F.lit(" \t\r"))), False),
    "path-modified": (lambda t: F.transform(F.filter(_all(t, PATH, 1), lambda v: ~F.regexp_like(v, F.lit(NO_PATH))), lambda v: F.regexp_replace(v, r"[.,;:!?)\]}]+$", "")), False),
    "heading-modified": (lambda t: F.transform(_all(t, HEADING, 1), lambda v: F.btrim(v, F.lit(" \t\r"))), True),
}


def preservation(pairs: DataFrame) -> DataFrame:
    """(pair_id, status, errors) of each pair (pair_id, source, candidate): the codes of what the candidate does not keep, in order."""
    failed = []
    for code, (held, ordered) in CHECKS.items():
        a, b = (held(F.coalesce(side, F.lit(""))) for side in ("source", "candidate"))
        same = a == b if ordered else F.array_sort(a) == F.array_sort(b)
        failed.append(F.when(~same, F.lit(code)))
    equal = F.coalesce("source", F.lit("")) == F.coalesce("candidate", F.lit(""))
    errors = F.when(equal, F.array().cast("array<string>")).otherwise(F.filter(F.array(*failed), lambda c: c.isNotNull()))
    told = pairs.select("pair_id", errors.alias("e"))
    return told.select("pair_id", F.when(F.size("e") == 0, "literal_preservation_passed").otherwise("preservation_failed").alias("status"), F.array_join("e", ",").alias("errors"))
