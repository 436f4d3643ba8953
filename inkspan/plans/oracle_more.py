"""SQL of the integrity, pair, corpus, review and calibration operators."""

from __future__ import annotations

from ..functions import rules
from ..functions import text as T
from ..operators import corpus as C
from ..operators import integrity as I
from ..operators import pairs as P
from ..operators import review as R
from .oracle import FOLDED, GROUPED, SEEDED, findings_ctes, folded, masked, q, scored_ctes, spans, union
from .oracle_stats import paragraphs, sentences

UNFOLDED = f"{SEEDED}, prepared AS (SELECT doc_id, text, text AS folded FROM seeded)"
BLANKED = masked(masked("folded", T.CODE), T.QUOTED)


def _list(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def _keys(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), {q(r'[.,;:!?)\]}]+$')}, '')"
    return f"list_transform(list_filter(string_split(regexp_extract({bare}, {q(r'\?(.*)$')}, 1), '&'), lambda p: p <> ''), lambda p: lower(string_split(p, '=')[1]))"


def _tracking(url: str) -> str:
    return f"(len({_keys(url)}) > 0 AND len(list_filter({_keys(url)}, lambda k: NOT list_contains({_list(I.TRACKING)}, k))) = 0)"


def _integrity(source: str = UNFOLDED, prefix: str = "") -> str:
    parts = [spans(f"k_{k}", "prepared", BLANKED, k, "strict", p) for k, p in I.SPAN_KINDS.items()]
    parts += [spans("k_url", "prepared", BLANKED, "tracking_parameter", "strict", I.URL), spans("k_run", "prepared", BLANKED, "homoglyph", "strict", I.LETTER_RUN, f"regexp_matches({BLANKED}, {q(I.LOOKALIKE)})")]
    names = union([f"k_{k}" for k in I.SPAN_KINDS])
    found = f"found AS ({names} UNION ALL SELECT * FROM k_url WHERE {_tracking('value')} UNION ALL SELECT * FROM k_run WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, {q(I.LOOKALIKE)}))"
    return f"{source},\n" + ",\n".join(parts) + f",\n{found}"


def integrity_findings() -> str:
    return f"""WITH {_integrity()}
SELECT f.doc_id, rule_id AS kind, 'oi-' || rule_id || '-' || row_number() OVER (PARTITION BY f.doc_id, rule_id ORDER BY start_pos, end_pos) AS finding_id, start_pos, end_pos, value, CASE WHEN len(regexp_extract_all(s.text, {q(r'[^\s]+')})) < {I.SHORT_SAMPLE} THEN 'uncertain' ELSE 'confident' END AS confidence
FROM found f JOIN seeded s ON f.doc_id = s.doc_id"""


def edit_defects() -> str:
    parts = ",\n".join(spans(f"e_{k}", "prepared", BLANKED, k, "strict", p) for k, p in I.EDIT_KINDS.items())
    return f"""WITH {UNFOLDED},
{parts},
found AS ({union([f'e_{k}' for k in I.EDIT_KINDS])})
SELECT doc_id, rule_id AS kind, start_pos, end_pos, value FROM found f WHERE NOT (rule_id = 'leaked_markup' AND EXISTS (SELECT 1 FROM found t WHERE t.doc_id = f.doc_id AND t.rule_id = 'leaked_prompt_token' AND f.start_pos < t.end_pos AND t.start_pos < f.end_pos))"""


def baseline() -> str:
    kinds = ", ".join(f"({q(k)})" for k in I.KINDS)
    raw = _integrity("seeded AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 1), prepared AS (SELECT doc_id, text, text AS folded FROM seeded)")
    return f"""WITH kinds(kind) AS (VALUES {kinds}),
now AS (WITH {_integrity()} SELECT s.doc_id, k.kind, count(f.doc_id) AS n FROM seeded s CROSS JOIN kinds k LEFT JOIN found f ON f.doc_id = s.doc_id AND f.rule_id = k.kind GROUP BY ALL),
before AS (WITH {raw} SELECT s.doc_id, k.kind, count(f.doc_id) AS was FROM seeded s CROSS JOIN kinds k LEFT JOIN found f ON f.doc_id = s.doc_id AND f.rule_id = k.kind GROUP BY ALL)
SELECT doc_id, kind, n, was, CASE WHEN kind = 'homoglyph' THEN 'disabled' WHEN was IS NULL THEN 'unmatched' WHEN was = 0 AND n > 0 THEN 'new' WHEN n > was THEN 'worsened' WHEN n = 0 AND was > 0 THEN 'resolved' ELSE 'unchanged' END AS state FROM now LEFT JOIN before USING (doc_id, kind)"""


def tracking_pages() -> str:
    return f"WITH k AS (SELECT page_id, url, {_keys('url')} AS keys FROM pages) SELECT page_id, CAST(len(keys) AS BIGINT) AS parameters, array_to_string(list_sort(keys), ',') AS keys, {_tracking('url')} AS tracking FROM k WHERE len(keys) > 0"


PAIRS = f"{SEEDED}, pairs AS (SELECT doc_id AS pair_id, {folded('text')} AS source, {folded(P.CANDIDATE_SQL)} AS candidate FROM seeded)"


def _changes(patterns: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT pair_id, {q(k)} AS category, unnest(regexp_extract_all({side}, {q(p)}, 0)) AS value, {n} AS n FROM pairs" for k, p in patterns.items() for side, n in (("source", 1), ("candidate", -1)))
    return f"""WITH {PAIRS}, sides AS ({rows}),
canonical AS (SELECT pair_id, category, CASE category WHEN 'number' THEN regexp_replace(value, '[%,]', '', 'g') WHEN 'date' THEN regexp_replace(value, '[/ ]', '-', 'g') ELSE value END AS value, n FROM sides),
counted AS (SELECT pair_id, category, value, sum(n) AS n FROM canonical GROUP BY ALL HAVING sum(n) <> 0)
SELECT pair_id, category, value, CAST(greatest(n, 0) AS BIGINT) AS lost, CAST(greatest(-n, 0) AS BIGINT) AS gained FROM counted"""


def literal_changes() -> str:
    return _changes(P.LITERALS)


def anchor_changes() -> str:
    return _changes(P.ANCHORS)


def marker_changes() -> str:
    terms = ", ".join(f"({q(k)}, {n}, {q(t)})" for k, ts in P.MARKERS.items() for n, t in enumerate(ts))
    return f"""WITH {PAIRS}, terms(dimension, n, term) AS (VALUES {terms}),
held AS (SELECT pair_id, dimension, n, term, regexp_matches(lower(source), '\\b' || term || '\\b') AS a, regexp_matches(lower(candidate), '\\b' || term || '\\b') AS b FROM pairs, terms WHERE contains(lower(source), term) OR contains(lower(candidate), term))
SELECT pair_id, dimension, coalesce(string_agg(term, ',' ORDER BY n) FILTER (WHERE a AND NOT b), '') AS missing, coalesce(string_agg(term, ',' ORDER BY n) FILTER (WHERE b AND NOT a), '') AS added, count(*) FILTER (WHERE a) AS in_source
FROM held GROUP BY pair_id, dimension HAVING count(*) FILTER (WHERE a <> b) > 0"""


def digests() -> str:
    return f"WITH {SEEDED}, b AS (SELECT doc_id, regexp_replace(text, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g') AS body FROM seeded) SELECT doc_id, sha256(body) AS body_digest, sha256(doc_id::VARCHAR || chr(10) || body) AS record_digest FROM b"


def _repairs() -> str:
    pattern = r"(?i)\b(?:" + "|".join(sorted(rules.CORRECTIONS, key=len, reverse=True)) + r")\b"
    table = ", ".join(f"({q(a)}, {q(b)})" for a, b in rules.CORRECTIONS.items())
    return f"{FOLDED}, corrections(original, replacement) AS (VALUES {table}),\n{spans('fixes', 'prepared', BLANKED, 'correction', 'strict', pattern)}"


def repairs() -> str:
    return f"WITH {_repairs()} SELECT doc_id, value AS original, replacement, start_pos, end_pos FROM fixes JOIN corrections ON lower(value) = original"


def repaired() -> str:
    return f"""WITH {_repairs()},
e AS (SELECT f.doc_id, s.text, start_pos, end_pos, replacement, lag(end_pos, 1, 0) OVER (PARTITION BY f.doc_id ORDER BY start_pos) AS done FROM fixes f JOIN corrections ON lower(value) = original JOIN seeded s ON s.doc_id = f.doc_id),
g AS (SELECT doc_id, any_value(text) AS text, count(*) AS edits, string_agg(substr(text, done + 1, start_pos - done) || replacement, '' ORDER BY start_pos) || substr(any_value(text), max(end_pos) + 1) AS fixed FROM e GROUP BY doc_id)
SELECT doc_id, edits, CAST(length(fixed) - length(text) AS BIGINT) AS longer_by, sha256(fixed) AS fixed_sha256 FROM g"""


def _set(sentence: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower(coalesce({sentence}, '')), {q(T.WORD)}, 0)))"


SHAPES = f"""{FOLDED},
p AS (SELECT doc_id, {paragraphs(masked('folded', T.CODE))} AS p FROM prepared),
s AS (SELECT doc_id, p, {sentences('p[1]')} AS first, {sentences("coalesce(p[2], '')")} AS second, {sentences('p[-1]')} AS last, flatten(list_transform(p, lambda x: {sentences('x').replace('lambda s', 'lambda y').replace('trim(s,', 'trim(y,').replace("s <> ''", "y <> ''")})) AS whole FROM p WHERE len(p) > 0),
shapes AS (SELECT doc_id, {_set('first[1]')} AS hook, CASE WHEN len(p) >= 2 THEN {_set('second[1]')} ELSE {_set('first[1]')} END AS reveal, {_set(f"coalesce(list_filter(whole, lambda z: regexp_matches(z, {q(C.LESSON)}))[1], last[1])")} AS lesson, {_set('last[-1]')} AS close FROM s)"""


def shapes() -> str:
    columns = ", ".join(f"array_to_string({s}, ' ') AS {s}" for s in C.SLOTS)
    return f"WITH {SHAPES} SELECT doc_id, {columns} FROM shapes"


def convergent() -> str:
    alike = " + ".join(f"CASE WHEN len(a.{s}) > 0 AND len(b.{s}) > 0 AND len(list_intersect(a.{s}, b.{s}))::DOUBLE / len(list_distinct(list_concat(a.{s}, b.{s}))) >= {C.LEAST}::DOUBLE THEN 1 ELSE 0 END" for s in C.SLOTS)
    return f"""WITH {SHAPES},
reps AS (SELECT hook, reveal, lesson, close, min(doc_id) AS rep FROM shapes GROUP BY ALL),
scored AS (SELECT a.rep AS doc_a, b.rep AS doc_b, CAST({alike} AS BIGINT) AS slots FROM reps a JOIN reps b ON a.rep < b.rep)
SELECT * FROM scored WHERE slots >= {C.MIN_SLOTS}"""


def convergent_members() -> str:
    filled = " + ".join(f"CASE WHEN len({s}) > 0 THEN 1 ELSE 0 END" for s in C.SLOTS)
    same = f"OVER (PARTITION BY {', '.join(C.SLOTS)})"
    return f"WITH {SHAPES} SELECT doc_id, min(doc_id) {same} AS rep, count(*) {same} AS documents, count(*) {same} > 1 AND {filled} >= {C.MIN_SLOTS} AS convergent FROM shapes"


def routed() -> str:
    m = lambda *p: f"regexp_matches(text, {q(R.any_of(p))})"
    return f"""WITH seeded AS (SELECT conv_id, turn, role, {R.SEEDED_REQUEST} AS text FROM conversations),
r AS (SELECT conv_id, turn, role, CASE WHEN {m(*R.NON_PROSE)} THEN 'none' WHEN {m(*R.AUDIT)} THEN CASE WHEN {m(R.DETECT_ONLY)} THEN 'detect' ELSE 'audit' END WHEN {m(*R.STYLE)} THEN CASE WHEN {m(R.EDIT_FILE)} THEN 'edit' ELSE 'rewrite' END ELSE 'none' END AS mode FROM seeded)
SELECT conv_id, turn, role, CASE WHEN mode = 'none' THEN 'none' ELSE 'prose' END AS skill, mode FROM r"""


STATUS = "CASE WHEN signal = 'strict' AND severity = 'high' THEN 'cut' WHEN signal = 'strict' THEN 'revise' WHEN severity = 'high' THEN 'ask-author' ELSE 'keep' END"


def decisions() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE status = {q(s)}) AS {s.replace('-', '_')}" for s in R.STATUS_WEIGHT if s != "no-finding")
    weight = "CASE status " + " ".join(f"WHEN {q(s)} THEN {w}" for s, w in R.STATUS_WEIGHT.items()) + " END"
    return f"WITH {findings_ctes()},\n{GROUPED},\nst AS (SELECT doc_id, {STATUS} AS status FROM weighed)\nSELECT doc_id, {counts}, arg_max(status, {weight}) AS decision FROM st GROUP BY doc_id"


def interventions() -> str:
    return f"WITH {findings_ctes()},\n{GROUPED},\nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE signal WHEN 'strict' THEN 0 ELSE 1 END, weight DESC, start_pos, end_pos, rule_id) AS rank FROM weighed)\nSELECT doc_id, rank, rule_id, start_pos, end_pos FROM r WHERE rank <= 2"


LABELLED = "labelled AS (SELECT d.lang, d.source, s.score, l.quality * 100 AS target, l.quality = 0 AS expected, s.score < 95 AS flagged FROM scores s JOIN documents d USING (doc_id) JOIN labels l USING (doc_id))"


def pooled_rates() -> str:
    return f"""WITH {scored_ctes()}, {LABELLED},
g AS (SELECT lang, source, count(*) FILTER (WHERE expected AND flagged) AS hits, count(*) FILTER (WHERE expected) AS positives, count(*) FILTER (WHERE NOT expected AND flagged) AS false_hits, count(*) FILTER (WHERE NOT expected) AS negatives FROM labelled GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, hits, positives, false_hits, negatives, CASE WHEN positives > 0 THEN round(hits::DOUBLE / positives, 4) END AS recall, CASE WHEN negatives > 0 THEN round(false_hits::DOUBLE / negatives, 4) END AS false_positive_rate FROM g"""


def agreement() -> str:
    return f"""WITH {scored_ctes()}, {LABELLED},
ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS b FROM labelled)
SELECT count(*) AS documents, round(avg(abs(score - target)), 4) AS mean_absolute_error, round(corr(a, b), 4) AS spearman FROM ranked"""
