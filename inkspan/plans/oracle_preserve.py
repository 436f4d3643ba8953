"""SQL of the literal preservation checks."""

from __future__ import annotations

from ..operators import preserve as V
from .oracle import SEEDED, masked, q

#: A deterministic rewrite, as plain SQL over ``text``, that loses and changes some of what it should keep.
REWRITE_SQL = "replace(replace(replace(replace(replace(replace(text, '45%', '46%'), '# Introduction', '# Intro'), 'leverage synergy' || chr(10), 'use' || chr(10)), '\"robust quotes\"', '\"strong quotes\"'), '`delve`', '`dig`'), 'utm_source=chatgpt.com', 'ref=openai')"


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def _replaced(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def _each(values: str, body: str) -> str:
    return f"list_transform({values}, lambda v: {body})"


def preservation() -> str:
    prose = masked(masked("t", V.FRONTMATTER), f"(?ms){V.PROTECTED}")
    trimmed = lambda p: _each(_all("t", p), _replaced("v", r"[\r\n]+$"))
    twice = _replaced(_replaced(_replaced("v", r"[.,;:!?]+$"), V.REFERRER, r"\1\2"), V.REFERRER, r"\1\2")
    bare = "trim(v, ' ' || chr(9) || chr(13))"
    held = {
        "frontmatter-modified": trimmed(V.FRONTMATTER),
        "code-block-modified": trimmed(V.FENCED),
        "blockquote-modified": trimmed(V.BLOCKQUOTE),
        "inline-code-modified": _all("t", V.INLINE),
        "table-modified": trimmed(V.TABLE),
        "url-modified": _each(_all("t", V.URL), _replaced(twice, r"[?&]+(#|$)", r"\1")),
        "numeric-literal-modified": _all(prose, V.NUMBER),
        "quotation-modified": _all(prose, V.QUOTATION),
        "attribution-modified": _each(_all("t", V.BYLINE), bare),
        "path-modified": _each(f"list_filter({_all('t', V.PATH, 1)}, lambda v: NOT regexp_matches(v, {q(V.NO_PATH)}))", _replaced("v", r"[.,;:!?)\]}]+$")),
        "heading-modified": _each(_all("t", V.HEADING, 1), bare),
    }
    columns = ", ".join(f"{v if V.CHECKS[k][1] else f'list_sort({v})'} AS c{i}" for i, (k, v) in enumerate(held.items()))
    tests = ", ".join(f"CASE WHEN a.c{i} IS DISTINCT FROM b.c{i} THEN {q(k)} END" for i, k in enumerate(held))
    return f"""WITH {SEEDED}, sides AS (SELECT doc_id, 0 AS side, coalesce(text, '') AS t FROM seeded UNION ALL SELECT doc_id, 1, coalesce({REWRITE_SQL}, '') FROM seeded),
made AS (SELECT doc_id, side, {columns} FROM sides),
told AS (SELECT a.doc_id AS pair_id, list_filter([{tests}], lambda c: c IS NOT NULL) AS e FROM made a JOIN made b ON a.doc_id = b.doc_id AND a.side = 0 AND b.side = 1)
SELECT pair_id, CASE WHEN len(e) = 0 THEN 'literal_preservation_passed' ELSE 'preservation_failed' END AS status, array_to_string(e, ',') AS errors FROM told"""
