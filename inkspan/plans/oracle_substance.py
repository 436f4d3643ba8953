"""SQL of the substance operators."""

from __future__ import annotations

from ..functions import text as T
from ..operators import stats as S
from ..operators import substance as B
from .oracle import FOLDED, masked, masked_text, q, spans
from .oracle_more import anchor_changes, literal_changes
from .oracle_stats import CODE, SECTIONS, paragraphs, sentences, words


def _has(pattern: str, column: str = "t") -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def dimensions() -> str:
    plain = lambda p: f"CASE WHEN {_has(p)} THEN 'unsupported' ELSE 'evidenced' END"
    concrete = f"CASE WHEN {_has(B.CONCRETE, 'f')} THEN 'evidenced' ELSE 'unknown' END"
    runs = "list_filter(range(1, len(n) - 1), lambda i: greatest(n[i], n[i+1], n[i+2]) - least(n[i], n[i+1], n[i+2]) <= 2)"
    return f"""WITH {FOLDED}, m AS (SELECT doc_id, {masked_text('code_quotes')} AS t, folded AS f FROM prepared), made AS (SELECT *, list_transform({sentences('t')}, lambda s: len({words('s')})) AS n FROM m)
SELECT doc_id, {plain(B.ANNOUNCEMENT)} AS directness, CASE WHEN len(n) < 3 THEN 'unknown' WHEN len({runs}) > 0 THEN 'unsupported' ELSE 'evidenced' END AS rhythm, {plain(B.HANDHOLD)} AS trust, {plain(B.INAUTHENTIC)} AS authenticity, {plain(B.CUTTABLE)} AS density,
CASE WHEN {_has(B.VAGUE)} THEN 'unsupported' ELSE {concrete} END AS specificity, CASE WHEN {_has(B.PUFFERY)} THEN 'unsupported' ELSE {concrete} END AS restraint,
CASE WHEN {_has(B.STANCE)} AND {_has(B.STAKES)} THEN 'evidenced' WHEN NOT {_has(B.STANCE)} AND {_has(B.STANCE, 'f')} THEN 'unknown' ELSE 'unsupported' END AS voice FROM made"""


def venue_features() -> str:
    columns = ", ".join(f"{_has(p, 'last' if k == 'reflection_tail' else 't')} AS {k}" for k, p in B.VENUE_FEATURES.items())
    return f"WITH {FOLDED}, m AS (SELECT doc_id, {CODE} AS t FROM prepared), made AS (SELECT doc_id, t, coalesce(({sentences('t')})[-1], '') AS last FROM m) SELECT doc_id, {columns} FROM made"


def paragraph_order() -> str:
    stop = "[" + ", ".join(map(q, S.STOP_WORDS)) + "]"
    content = f"list_filter(list_distinct(regexp_extract_all(lower(x), {q(chr(91) + 'a-z' + chr(93) + '[a-z' + chr(39) + '-]*')}, 0)), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    overlap = "len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, least(len(a.w), len(b.w)))"
    return f"""WITH {FOLDED}, m AS (SELECT doc_id, {paragraphs(CODE)} AS p FROM prepared),
k AS (SELECT doc_id, p, list_transform(p, lambda x: {content}) AS w FROM m WHERE len(p) > 1),
r AS (SELECT doc_id, unnest(p) AS p, unnest(w) AS w, unnest(range(0, len(p))) AS i FROM k),
j AS (SELECT a.doc_id, a.i, len(a.w) >= {B.TREADMILL_WORDS} AND len(b.w) >= {B.TREADMILL_WORDS} AND {overlap} >= {B.TREADMILL} AS treads, len(a.w) < {B.SHUFFLE_WORDS} OR len(b.w) < {B.SHUFFLE_WORDS} OR regexp_matches(b.p, {q(B.CONNECTIVE)}) OR {overlap} >= {B.SHUFFLE} AS tied FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
l AS (SELECT *, lead(tied) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM j)
SELECT doc_id, CAST(count(*) + 1 AS BIGINT) AS paragraphs, count(*) FILTER (WHERE treads) AS restated, CAST(min(i) FILTER (WHERE NOT tied AND NOT coalesce(later, TRUE)) AS BIGINT) AS reshuffle_from FROM l GROUP BY doc_id"""


def tricolons() -> str:
    return f"""WITH {SECTIONS}, made AS (SELECT doc_id, section, {sentences('flat')} AS s FROM sections),
told AS (SELECT doc_id, section, CAST(len(s) AS BIGINT) AS sentences, CAST(len(list_filter(s, lambda x: {_has(B.TRICOLON, 'x')})) AS BIGINT) AS tricolons FROM made)
SELECT *, tricolons >= 4 AND tricolons::DOUBLE / sentences >= 0.2 AS dense FROM told WHERE tricolons > 0"""


def colon_reveals() -> str:
    label, clause = ("[" + ", ".join(map(q, w)) + "]" for w in (B.LABEL_WORDS, B.CLAUSE_WORDS))
    before = f"regexp_extract_all(lower(regexp_replace(regexp_extract(value, '^([^:]*):', 1), {q(T.FOREIGN_LETTER)}, 'x', 'g')), '[a-z]+')"
    subject = masked(masked("folded", T.CODE), T.QUOTED)
    return f"WITH {FOLDED},\n{spans('c', 'prepared', subject, 'struct-colon-reveal', 'advisory', B.COLON_REVEAL)}\nSELECT * FROM c WHERE NOT (list_contains({label}, {before}[-1]) OR list_has_any({before}, {clause}))"


def gate() -> str:
    return f"""WITH literal AS ({literal_changes()}), anchor AS ({anchor_changes()}),
w AS (SELECT pair_id, 2 AS w FROM literal WHERE lost > 0 UNION ALL SELECT pair_id, CASE WHEN category IN ('attribution', 'name') THEN 1 ELSE 2 END AS w FROM anchor),
g AS (SELECT pair_id, max(w) AS w, count(*) AS changes FROM w GROUP BY pair_id)
SELECT d.doc_id AS pair_id, CASE w WHEN 2 THEN 'reject' WHEN 1 THEN 'review' ELSE 'accept' END AS decision, coalesce(changes, 0) AS changes FROM documents d LEFT JOIN g ON d.doc_id = g.pair_id"""
