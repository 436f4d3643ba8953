"""The same results in ANSI-style SQL over the plain tables, for comparison with another engine."""

from __future__ import annotations

from ..functions import rules
from ..functions import text as T
from ..functions.seeds import seeded_sql
from ..operators import detect
from . import oracle_measured
from .oracle_measured import q


def folded(text: str) -> str:
    return f"regexp_replace({text}, {q(T.FOREIGN_LETTER)}, 'x', 'g')"


SEEDED = f"seeded AS (SELECT doc_id, {seeded_sql()} AS text FROM documents)"
FOLDED = f"{SEEDED}, prepared AS (SELECT doc_id, text, {folded('text')} AS folded FROM seeded)"


def masked(text: str, pattern: str) -> str:
    pieces, hits = f"string_split_regex({text}, {q(pattern)})", f"regexp_extract_all({text}, {q(pattern)}, 0)"
    return f"array_to_string(list_transform(list_zip({pieces}, list_transform({hits}, lambda h: repeat(' ', length(h)))), lambda z: z[1] || coalesce(z[2], '')), '')"


def masked_text(mask: str, text: str = "folded") -> str:
    if not mask:
        return text
    code = masked(text, T.CODE)
    return {"code": code, "code_quotes": masked(code, T.QUOTED), "prose": masked(code, T.NO_PROSE_LINES)}[mask]


def excused(d: detect.Detector) -> str:
    """Whether what stands around a match excuses it."""
    around = f"substr(subject, greatest(0, start_pos - {d.around}) + 1, end_pos + {d.around} - greatest(0, start_pos - {d.around}))"
    before = f"substr(subject, greatest(0, start_pos - {detect.ESTIMATE_BEFORE}) + 1, start_pos - greatest(0, start_pos - {detect.ESTIMATE_BEFORE}))"
    after = f"substr(subject, end_pos + 1, {detect.ESTIMATE_AFTER})"
    words = lambda t: f"regexp_extract_all({t}, {q(chr(92) + 'S+')}, 0)"
    parts = ["FALSE"]
    if d.estimates:
        parts += [f"regexp_matches(array_to_string(({words(before)})[-{detect.WORDS_BEFORE}:], ' '), {q(detect.ESTIMATED)})", f"regexp_matches(array_to_string(({words(after)})[1:{detect.WORDS_AFTER}], ' '), {q(detect.OR_SO)})", f"contains(right({before}, 3), '~')", f"contains(left({after}, 3), '~')"]
    if d.excuse:
        parts.append(f"regexp_matches({around}, {q(d.excuse)})")
    if d.actors:
        stop = "[" + ", ".join(map(q, detect.ACTOR_STOP)) + "]"
        parts.append(f"len(list_filter(string_split_regex(array_to_string(regexp_extract_all({around}, {q(detect.NAMED_ACTOR)}, 1), ' '), {q(chr(92) + 's+')}), lambda w: w <> '' AND NOT list_contains({stop}, w))) > 0")
    return " OR ".join(parts)


def spans(name: str, source: str, subject: str, rule_id: str, signal: str, pattern: str, guard: str = "TRUE", excuse: str = "FALSE") -> str:
    """Common table expressions; the last, called ``name``, has the findings."""
    return f"""{name}_s AS (SELECT doc_id, text, {subject} AS subject FROM {source} WHERE {guard}),
{name}_h AS (SELECT doc_id, text, subject, string_split_regex(subject, {q(pattern)}) AS g, regexp_extract_all(subject, {q(pattern)}, 0) AS h FROM {name}_s WHERE regexp_matches(subject, {q(pattern)})),
{name}_e AS (SELECT doc_id, text, subject, g, h, unnest(range(1, len(h) + 1)) AS i FROM {name}_h),
{name}_p AS (SELECT doc_id, text, subject, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_pos, CAST(length(h[i]) AS BIGINT) AS n FROM {name}_e),
{name}_q AS (SELECT doc_id, text, subject, start_pos, start_pos + n AS end_pos FROM {name}_p),
{name} AS (SELECT doc_id, {q(rule_id)} AS rule_id, {q(signal)} AS signal, 'span' AS evidence, start_pos, end_pos, substr(text, start_pos + 1, end_pos - start_pos) AS value FROM {name}_q WHERE NOT ({excuse}))"""


def lexical(profile: str = "general") -> tuple[str, list[str]]:
    parts, names = [], []
    for rule in rules.active(profile):
        if pattern := rules.pattern(rule):
            name = f"r{rule.ordinal}"
            guard = "(" + " OR ".join(f"contains(lower(folded), {q(n)})" for n in rules.needles(rule)) + ")"
            parts.append(spans(name, "prepared", "folded", rule.rule_id, rule.signal, pattern, guard))
            names.append(name)
    return ",\n".join(parts), names


def patterns(keys: list[str] | None = None, profile: str = "") -> tuple[str, list[str]]:
    parts, names = [], []
    for d in detect.patterns_of(profile) if profile else [detect.BY_KEY[k] for k in keys or detect.BY_KEY]:
        parts.append(spans(f"d_{d.key}", "prepared", masked_text(d.mask), detect.RULE_OF.get(d.key, d.key), d.signal, d.pattern, "TRUE", excused(d)))
        names.append(f"d_{d.key}")
    return ",\n".join(parts), names


def union(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)


def lexical_findings(profile: str = "general") -> str:
    parts, names = lexical(profile)
    return f"WITH {FOLDED},\n{parts}\n{union(names)}"


def pattern_findings(keys: list[str] | None = None) -> str:
    parts, names = patterns(keys)
    return f"WITH {FOLDED},\n{parts}\n{union(names)}"


def _registry() -> str:
    rows = ", ".join(f"({q(r.rule_id)}, {q(r.category)}, {q(r.severity)}, {q(r.review)}, {q(r.signal)}, {q(r.detector) if r.detector else 'NULL'}, {r.weight}, {r.ordinal})" for r in rules.RULES)
    return f"registry(rule_id, category, severity, review, rule_signal, detector, weight, ordinal) AS (VALUES {rows})"


def findings_ctes(profile: str = "general", measured: bool = True) -> str:
    from . import oracle_linkage

    a, names_a = lexical(profile)
    b, names_b = patterns(profile=profile)
    c, names_c = oracle_measured.ctes(masked_text("code_quotes"), {"treadmill_prose": oracle_linkage.treadmill_prose(), "paragraph_reshuffle": oracle_linkage.paragraph_reshuffle()})
    if not measured:
        c, names_c = "no_measures AS (SELECT 1)", []
    return f"{FOLDED},\n{a},\n{b},\n{c},\nfindings AS ({union(names_a + names_b + names_c)}),\n{_registry()}"


def measured_findings() -> str:
    return f"WITH {findings_ctes()} SELECT * FROM findings WHERE evidence = 'document' OR rule_id IN ({', '.join(q(detect.RULE_OF[m.key]) for m in detect.M.MEASURES)})"


GROUPED = """rated AS (SELECT f.*, coalesce(r.category, 'structural') AS category, coalesce(r.severity, 'medium') AS severity, coalesce(r.weight, 4) AS weight, coalesce(r.ordinal, 185) AS ordinal FROM findings f LEFT JOIN registry r USING (rule_id)),
turned AS (SELECT *, CASE WHEN evidence <> lag(evidence) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, ordinal, rule_id) THEN 1 ELSE 0 END AS turn FROM rated),
kinds AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, ordinal, rule_id ROWS UNBOUNDED PRECEDING) AS kind_run FROM turned),
reached AS (SELECT *, max(end_pos) OVER (PARTITION BY doc_id, kind_run ORDER BY start_pos, end_pos, ordinal, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kinds),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, ordinal, rule_id ROWS UNBOUNDED PRECEDING) AS island FROM reached),
grouped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY CASE signal WHEN 'strict' THEN 0 ELSE 1 END, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, length(rule_id) DESC, start_pos, end_pos, ordinal, rule_id) = 1 AS is_primary FROM islands),
nth AS (SELECT *, is_primary AND signal = 'strict' AS scored, row_number() OVER (PARTITION BY doc_id, rule_id, is_primary AND signal = 'strict' ORDER BY start_pos, end_pos, ordinal) AS n FROM grouped),
weighed AS (SELECT *, CASE WHEN scored THEN weight * (CASE WHEN n = 1 THEN 1.0 WHEN n = 2 THEN 0.5 WHEN n <= 8 THEN 0.25 ELSE 0.0 END) ELSE 0.0 END AS deduction FROM nth)"""


def registry_rows() -> str:
    return f"WITH {_registry()} SELECT * FROM registry"


def grouped_findings() -> str:
    return f"WITH {findings_ctes()},\n{GROUPED}\nSELECT doc_id, rule_id, signal, category, severity, start_pos, end_pos, CAST(island AS BIGINT) AS island, is_primary, CAST(deduction AS DOUBLE) AS deduction FROM weighed"


def scored_ctes() -> str:
    bands = " ".join(f"WHEN score >= {least} THEN {q(name)}" for least, name in rules.BANDS)
    words = f"len(regexp_extract_all(coalesce(text, ''), {q(r'[^\s]+')}))"
    return f"""{findings_ctes()},
{GROUPED},
summed AS (SELECT doc_id, count(*) AS n_findings, count(*) FILTER (WHERE is_primary) AS n_primary, count(*) FILTER (WHERE signal = 'advisory') AS n_advisory, count(*) FILTER (WHERE scored) AS n_scored, sum(deduction) AS total FROM weighed GROUP BY doc_id),
counted AS (SELECT s.doc_id, CAST({words} AS BIGINT) AS words, coalesce(n_findings, 0) AS n_findings, coalesce(n_primary, 0) AS n_primary, coalesce(n_advisory, 0) AS n_advisory, coalesce(n_scored, 0) AS n_scored, CAST(coalesce(total, 0) AS DOUBLE) AS total FROM seeded s LEFT JOIN summed USING (doc_id)),
penalised AS (SELECT *, CAST(greatest(0, round_even(100.0 - CASE WHEN words > 0 THEN total * 500 / words ELSE total END, 0)) AS BIGINT) AS score FROM counted),
scores AS (SELECT doc_id, words, n_findings, n_primary, round(total, 2) AS penalty, score, CASE {bands} ELSE 'unknown' END AS band, CASE WHEN words > 0 THEN round(n_scored * 500.0::DOUBLE / words, 2) ELSE 0.0 END AS density, CASE WHEN n_advisory > 0 THEN 'manual_review_required' ELSE 'complete' END AS status FROM penalised)"""


def risk_score() -> str:
    return f"WITH {scored_ctes()}\nSELECT * FROM scores"


def band_counts() -> str:
    return f"WITH {scored_ctes()}\nSELECT band, count(*) AS documents, CAST(sum(n_findings) AS BIGINT) AS findings, min(score) AS least_score, round(avg(score), 4) AS mean_score FROM scores GROUP BY band"


def category_rollup() -> str:
    return f"""WITH {findings_ctes()},
{GROUPED}
SELECT coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS findings, count(*) FILTER (WHERE is_primary) AS primaries, count(DISTINCT doc_id) AS documents, CAST(sum(deduction) AS DOUBLE) AS deduction
FROM weighed GROUP BY GROUPING SETS ((category, severity), (category), ())"""
