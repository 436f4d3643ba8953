"""SQL of the findings of document-level detectors: common table expressions and their names, each with the columns of findings."""

from __future__ import annotations

from ..functions import limits as L
from ..functions import text as T
from ..operators import detect
from ..operators import measured as M

TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(T.WORD)}, 0)"


def cut(name: str, source: str, keys: str, subject: str, pattern: str, guard: str = "TRUE") -> str:
    """Pieces between a pattern's matches: keys, k (1, 2, ...), body and at, the piece's start in the subject."""
    by = keys.replace(", text", "")
    return f"""{name}_a AS (SELECT {keys}, string_split_regex({subject}, {q(pattern)}) AS b, regexp_extract_all({subject}, {q(pattern)}, 0) AS h FROM {source} WHERE {guard}),
{name}_b AS (SELECT {keys}, unnest(b) AS body, unnest(range(1, len(b) + 1)) AS k, unnest(list_transform(range(1, len(b) + 1), lambda i: coalesce(length(h[i]), 0))) AS gap FROM {name}_a),
{name} AS (SELECT {keys}, k, body, CAST(sum(length(body) + gap) OVER (PARTITION BY {by} ORDER BY k) - length(body) - gap AS BIGINT) AS pos FROM {name}_b)"""


def headings(name: str, subject: str) -> str:
    """Headings: doc_id, text, h (the line), pos, k."""
    return f"""{name}_a AS (SELECT doc_id, text, string_split_regex({subject}, {q(L.HEADING_LINE)}) AS g, regexp_extract_all({subject}, {q(L.HEADING_LINE)}, 0) AS h FROM prepared WHERE contains({subject}, '#')),
{name}_b AS (SELECT doc_id, text, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS k, unnest(list_transform(range(1, len(h) + 1), lambda i: length(g[i]))) AS gap FROM {name}_a),
{name} AS (SELECT doc_id, text, h, k, CAST(sum(length(h) + gap) OVER (PARTITION BY doc_id ORDER BY k) - length(h) AS BIGINT) AS pos FROM {name}_b)"""


def repeating(name: str, alike: str) -> str:
    return f"""{name}_pairs AS (SELECT a.doc_id, a.section, a.n AS i, b.n AS j FROM m_long a JOIN m_long b ON a.doc_id = b.doc_id AND a.section = b.section AND a.n < b.n WHERE {alike}),
{name}_hits AS (SELECT doc_id, section, i, list_prepend(i, list(j ORDER BY j)) AS hits FROM {name}_pairs GROUP BY doc_id, section, i),
{name}_flags AS (SELECT doc_id, section, list_reduce(list(hits ORDER BY i), lambda done, x: CASE WHEN list_contains(done, x[1]) THEN done ELSE done || list_filter(x[2:], lambda j: NOT list_contains(done, j))[1:1] END, []::BIGINT[]) AS flags FROM {name}_hits GROUP BY doc_id, section),
{name}_rows AS (SELECT p.doc_id, p.text, p.start_pos, p.end_pos FROM m_long p JOIN {name}_flags f ON p.doc_id = f.doc_id AND p.section = f.section WHERE list_contains(f.flags, p.n))"""


def even(values: str, least: int, mean: float, limit: float) -> str:
    total, squares = f"list_sum({values})", f"list_sum(list_transform({values}, lambda n: n * n))"
    return f"coalesce(len({values}) >= {least} AND {total} >= len({values}) * {mean}::DOUBLE AND sqrt((len({values}) * {squares} - {total} * {total})::DOUBLE) / {total} < {limit}::DOUBLE, FALSE)"


def ctes(code_quotes: str, linked: dict[str, str]) -> tuple[str, list[str]]:
    """``linked`` has whole queries by detector that tell doc_id, start_pos and end_pos."""
    bare = f"regexp_replace(regexp_replace(body, {q(L.FENCE)}, ' ', 'g'), {q(L.COMMENT)}, ' ', 'g')"
    flat = f"array_to_string(list_filter(list_transform(string_split({bare}, chr(10)), lambda x: trim(x, {TRIM})), lambda x: x <> '' AND NOT regexp_matches(x, {q(L.NO_PROSE_START)})), ' ')"
    opener = f"regexp_extract(lower(regexp_extract(x, {q(T.WORD)}, 0)), '[a-z].*', 0)"
    passive = f"len(list_filter(told, lambda x: len(list_filter(regexp_extract_all(x, {q(L.PASSIVE)}, 1), lambda w: NOT list_contains({listed(L.ADJECTIVES)}, lower(w)))) > 0))"
    transitions = " OR ".join(f"len(regexp_extract_all(lower(flat), {q(chr(92) + 'b' + t + chr(92) + 'b')})) >= {L.TRANSITION_COUNT}" for t in L.TRANSITIONS)
    most = "list_max(map_values(list_aggregate(firsts, 'histogram')))"
    shared, whole = "len(list_intersect(a.w, b.w))", "len(list_distinct(list_concat(a.w, b.w)))"
    tail = f"list_filter(w[2:], lambda x: NOT list_contains({listed(L.HEADING_SMALL)}, lower(x)))"
    names = listed(L.HEADING_NAMES)
    parts = [
        cut("m_cut", "prepared", "doc_id, text", "folded", L.HEADING),
        f"m_flat AS (SELECT doc_id, text, k AS section, body, pos AS start_pos, pos + length(body) AS end_pos, {flat} AS flat FROM m_cut WHERE body <> '')",
        f"m_sentences AS (SELECT *, list_filter(string_split_regex(flat, {q(T.SENTENCE_END)}), lambda x: x <> '') AS sentences FROM m_flat)",
        f"m_sections AS (SELECT *, list_filter(sentences, lambda x: len({words('x')}) >= {L.SENTENCE_MIN_WORDS}) AS told, list_filter(list_transform(sentences, lambda x: len({words('x')})), lambda n: n >= {L.SENTENCE_MIN_WORDS}) AS lengths, list_filter(list_transform(sentences, lambda x: {opener}), lambda w: length(w) >= 2) AS firsts FROM m_sentences)",
        cut("m_pcut", "(SELECT doc_id, section, text, body AS whole, start_pos FROM m_flat)", "doc_id, section, start_pos, text", "whole", T.PARAGRAPH_END),
        f"m_trimmed AS (SELECT doc_id, section, text, k, trim(body, {TRIM}) AS t, start_pos + pos AS start_pos, start_pos + pos + length(body) AS end_pos FROM m_pcut)",
        f"m_paragraphs AS (SELECT *, len({words('t')}) AS n_words FROM m_trimmed WHERE t <> '' AND NOT regexp_matches(t, {q(L.NO_PROSE_START)}))",
        f"m_long AS (SELECT doc_id, section, text, start_pos, end_pos, row_number() OVER (PARTITION BY doc_id, section ORDER BY k) AS n, list_distinct({words('lower(t)')}) AS w, regexp_replace(lower(t), {q('[^a-z0-9' + chr(92) + 's]')}, '', 'g') AS plain FROM m_paragraphs WHERE n_words >= {L.SIMILAR_WORDS})",
        f"m_sizes AS (SELECT doc_id, section, list(n_words) AS n FROM m_paragraphs WHERE n_words >= {L.PARAGRAPH_MIN_WORDS} GROUP BY doc_id, section)",
        repeating("m_same", f"a.plain = b.plain OR {shared} > {whole} * {L.DUPLICATE}::DOUBLE"),
        repeating("m_like", f"{shared} > {whole} * {L.SIMILAR}::DOUBLE AND {shared} >= {L.SIMILAR_SHARED}"),
        headings("m_titles", code_quotes),
        f"m_tokens AS (SELECT doc_id, text, pos AS start_pos, pos + length(h) AS end_pos, regexp_extract_all(regexp_replace(h, '^#+\\s+', ''), {q(L.HEADING_WORD)}, 0) AS w FROM m_titles)",
        headings("m_heads", "folded"),
        "m_levels AS (SELECT doc_id, text, pos AS start_pos, pos + length(h) AS end_pos, length(regexp_extract(h, '^#+', 0)) AS level, lag(length(regexp_extract(h, '^#+', 0))) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM m_heads)",
        cut("m_blocks", "prepared", "doc_id, text", code_quotes, M.BLANK_LINES, f"contains({code_quotes}, ';')"),
    ]
    found = {
        "paragraph_duplication": "SELECT * FROM m_same_rows",
        "passive_density": f"SELECT * FROM m_sections WHERE len(told) >= {L.PASSIVE_SENTENCES} AND {passive} >= {L.PASSIVE_COUNT} AND {passive} > len(told) * {L.PASSIVE_SHARE}::DOUBLE",
        "fmt_title_case": f"SELECT * FROM m_tokens WHERE len(w) >= 2 AND len({tail}) > 0 AND NOT list_contains({names}, lower(w[1])) AND len(list_filter({tail}, lambda x: NOT list_contains({names}, lower(x)))) > 0 AND len(list_filter({tail}, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0",
        "paragraph_similarity": "SELECT * FROM m_like_rows",
        "sentence_length_variance": f"SELECT * FROM m_sections WHERE {even('lengths', L.SENTENCE_MIN, L.MEAN_MIN, L.SENTENCE_CV)}",
        "paragraph_length_variance": f"SELECT s.* FROM m_flat s JOIN m_sizes z ON s.doc_id = z.doc_id AND s.section = z.section WHERE {even('z.n', L.PARAGRAPH_MIN, 0.0, L.PARAGRAPH_CV)}",
        "sentence_start_repetition": f"SELECT * FROM m_sections WHERE len(firsts) >= {L.OPENER_SENTENCES} AND {most} >= {L.OPENER_COUNT} AND {most} > len(firsts) * {L.OPENER_SHARE}::DOUBLE",
        "transition_repetition": f"SELECT * FROM m_sections WHERE {transitions}",
        "fmt_semicolon": f"SELECT doc_id, text, pos + length(regexp_extract(body, {q(M.LEADING)}, 0)) AS start_pos, pos + length(body) - length(regexp_extract(body, {q(M.TRAILING)}, 0)) AS end_pos FROM m_blocks WHERE len(regexp_extract_all(body, ';')) >= 2",
        "heading_hierarchy": "SELECT * FROM m_levels WHERE level > before + 1",
    }
    found |= {key: f"SELECT l.doc_id, p.text, l.start_pos, l.end_pos FROM ({sql}) l JOIN prepared p ON l.doc_id = p.doc_id" for key, sql in linked.items()}
    for m in M.MEASURES:
        value = "substr(text, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT))" if m.evidence == "span" else "NULL"
        parts.append(f"m_{m.key} AS (SELECT doc_id, {q(detect.RULE_OF[m.key])} AS rule_id, {q(m.signal)} AS signal, {q(m.evidence)} AS evidence, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, {value} AS value FROM ({found[m.key]}))")
    return ",\n".join(parts), [f"m_{m.key}" for m in M.MEASURES]
