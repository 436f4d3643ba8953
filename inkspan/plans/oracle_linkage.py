"""SQL of the links between neighbouring paragraphs."""

from __future__ import annotations

from ..operators import linkage as L
from .oracle import FOLDED, q

STOPS = "[" + ", ".join(map(q, L.STOP_WORDS)) + "]"


def prose(least: int) -> str:
    """Rows (doc_id, pos, start_pos, end_pos, body, words), numbered among those of enough words, beside the text."""
    words = f"list_distinct(list_filter(list_transform(regexp_extract_all(body, {q(L.CONTENT_WORD)}), lambda w: lower(w)), lambda w: length(w) >= {L.CONTENT_LETTERS} AND NOT list_contains({STOPS}, w)))"
    return f"""WITH {FOLDED},
cuts AS (SELECT doc_id, text, string_split_regex(text, {q(L.BREAK)}) AS p, regexp_extract_all(text, {q(L.BREAK)}) AS g FROM prepared WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, text, unnest(p) AS body, unnest(range(1, len(p) + 1)) AS n, unnest(list_transform(range(1, len(p) + 1), lambda i: coalesce(length(g[i]), 0))) AS gap FROM cuts),
placed AS (SELECT *, sum(length(body) + gap) OVER (PARTITION BY doc_id ORDER BY n) - length(body) - gap AS start_pos FROM pieces),
sets AS (SELECT doc_id, text, n, start_pos, start_pos + length(body) AS end_pos, body, {words} AS words FROM placed WHERE NOT starts_with(body, chr(10)) AND NOT regexp_matches(body, {q(L.NO_PROSE)})),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM sets WHERE len(words) >= {least}),
pairs AS (SELECT b.*, a.end_pos AS end_before, len(list_intersect(a.words, b.words)) AS shared, least(len(a.words), len(b.words)) AS smaller FROM kept b LEFT JOIN kept a ON a.doc_id = b.doc_id AND a.pos = b.pos - 1)"""


def treadmill_prose() -> str:
    return f"""{prose(L.TREADMILL_WORDS)}
SELECT doc_id, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, CAST(shared AS BIGINT) AS shared, round(shared::DOUBLE / smaller, 6) AS overlap FROM pairs WHERE shared::DOUBLE / smaller >= {L.TREADMILL_OVERLAP}::DOUBLE"""


def paragraph_reshuffle() -> str:
    return f"""{prose(L.ISLAND_WORDS)},
tied AS (SELECT *, NOT regexp_matches(body, {q(L.LITERAL)}) AS clean, regexp_matches(substring(text, (end_before + 1)::BIGINT, (start_pos - end_before)::BIGINT), {q(L.HEADING_LINE)}) OR regexp_matches(body, {q(L.CONNECTIVE)}) OR shared::DOUBLE / smaller >= {L.ISLAND_OVERLAP}::DOUBLE AS bound FROM pairs),
runs AS (SELECT doc_id, start_pos, pos, clean, lead(clean) OVER w AS clean2, lead(bound) OVER w AS bound2, lead(clean, 2) OVER w AS clean3, lead(bound, 2) OVER w AS bound3, lead(end_pos, 2) OVER w AS last FROM tied WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM runs WHERE clean AND clean2 AND clean3 AND NOT bound2 AND NOT bound3)
SELECT doc_id, CAST(start_pos AS BIGINT) AS start_pos, CAST(last AS BIGINT) AS end_pos FROM firsts WHERE k = 1"""
