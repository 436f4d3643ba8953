"""SQL of the document-level measures."""

from __future__ import annotations

from ..functions import text as T
from ..operators import stats as S
from .oracle import FOLDED, findings_ctes, masked_text, q

TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def _trimmed(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: trim(s, {TRIM})), lambda s: s <> '')"


def sentences(text: str) -> str:
    return _trimmed(f"string_split_regex({text}, {q(T.SENTENCE_END)})")


def paragraphs(text: str) -> str:
    return _trimmed(f"string_split_regex({text}, {q(T.PARAGRAPH_END)})")


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(T.WORD)}, 0)"


CODE = masked_text("code")
SECTIONS = f"""{FOLDED},
cuts AS (SELECT doc_id, string_split_regex({CODE}, {q(S.HEADING)}) AS b FROM prepared),
rows_ AS (SELECT doc_id, unnest(b) AS body, unnest(range(0, len(b))) AS section FROM cuts),
sections AS (SELECT doc_id, CAST(section AS BIGINT) AS section, body, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, {TRIM})), lambda x: x <> '' AND NOT regexp_matches(x, {q(S.SKIPPED_LINE)})), ' ') AS flat FROM rows_ WHERE trim(body, {TRIM}) <> '')"""


def _cv(values: str) -> str:
    return f"CASE WHEN list_avg({values}) > 0 THEN list_stddev_pop({values}) / list_avg({values}) END"


def rhythm() -> str:
    return f"""WITH {SECTIONS},
made AS (SELECT doc_id, section, list_filter(list_transform({sentences('flat')}, lambda s: len({words('s')})), lambda n: n >= {S.SENTENCE_MIN_WORDS}) AS l, list_filter(list_transform({paragraphs('body')}, lambda s: len({words('s')})), lambda n: n >= {S.PARAGRAPH_MIN_WORDS}) AS p FROM sections),
told AS (SELECT doc_id, section, CAST(len(l) AS BIGINT) AS sentences, round(list_avg(l), 4) AS mean_words, round({_cv('l')}, 4) AS sentence_cv, CAST(len(p) AS BIGINT) AS paragraphs, round({_cv('p')}, 4) AS paragraph_cv FROM made)
SELECT *, coalesce(sentences >= {S.SENTENCE_MIN} AND mean_words >= {S.MEAN_MIN} AND sentence_cv < {S.SENTENCE_CV}, FALSE) AS even_sentences, coalesce(paragraphs >= {S.PARAGRAPH_MIN} AND paragraph_cv < {S.PARAGRAPH_CV}, FALSE) AS even_paragraphs FROM told""".replace("list_stddev_pop(l)", "list_aggregate(l, 'stddev_pop')").replace("list_stddev_pop(p)", "list_aggregate(p, 'stddev_pop')")


def openers() -> str:
    return f"""WITH {SECTIONS},
made AS (SELECT doc_id, section, list_filter(list_transform({sentences('flat')}, lambda s: regexp_extract(lower(string_split(s, ' ')[1]), '[a-z].*', 0)), lambda w: length(w) >= 2) AS f FROM sections),
rows2 AS (SELECT doc_id, section, len(f) AS n, unnest(f) AS opener, unnest(range(0, len(f))) AS pos FROM made),
counted AS (SELECT doc_id, section, opener, CAST(max(n) AS BIGINT) AS openings, count(*) AS times, min(pos) AS pos FROM rows2 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY times DESC, pos) AS rank FROM counted)
SELECT doc_id, section, opener, openings, times, round(times / openings, 4) AS share, openings >= {S.OPENER_SENTENCES} AND times >= {S.OPENER_COUNT} AND times / openings > {S.OPENER_SHARE}::DOUBLE AS repeated FROM top WHERE rank = 1""".replace("round(times / openings", "round(times::DOUBLE / openings").replace("AND times / openings", "AND times::DOUBLE / openings")


def transitions() -> str:
    terms = ", ".join(f"({n}, {q(t)}, {q(chr(92) + 'b' + t + chr(92) + 'b')})" for n, t in enumerate(S.TRANSITIONS))
    return f"""WITH {SECTIONS}, terms(n, term, pattern) AS (VALUES {terms}),
counted AS (SELECT doc_id, section, n, term, CAST(len(regexp_extract_all(lower(flat), pattern)) AS BIGINT) AS times FROM sections, terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY n) AS k FROM counted WHERE times >= {S.TRANSITION_COUNT})
SELECT doc_id, section, term, times FROM ranked WHERE k = 1"""


def passives() -> str:
    stop = "[" + ", ".join(map(q, S.ADJECTIVES)) + "]"
    return f"""WITH {SECTIONS},
made AS (SELECT doc_id, section, {sentences('flat')} AS s FROM sections),
told AS (SELECT doc_id, section, CAST(len(s) AS BIGINT) AS sentences, CAST(len(list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, {q(S.PASSIVE)}, 1), lambda w: NOT list_contains({stop}, lower(w)))) > 0)) AS BIGINT) AS passive FROM made)
SELECT *, sentences >= {S.PASSIVE_SENTENCES} AND passive >= {S.PASSIVE_COUNT} AND passive::DOUBLE / sentences > {S.PASSIVE_SHARE} AS passive_heavy FROM told WHERE passive > 0"""


def long_sentences() -> str:
    return f"""WITH {SECTIONS}, made AS (SELECT doc_id, section, {sentences('flat')} AS s FROM sections),
rows2 AS (SELECT doc_id, section, unnest(s) AS s, unnest(range(0, len(s))) AS pos FROM made),
told AS (SELECT doc_id, section, CAST(pos AS BIGINT) AS sentence, CAST(len(regexp_extract_all(s, ',')) AS BIGINT) AS commas, CAST(len({words('s')}) AS BIGINT) AS words FROM rows2)
SELECT * FROM told WHERE commas >= {S.COMMAS} AND words >= {S.LONG_WORDS}"""


def semicolons() -> str:
    return f"""WITH {FOLDED}, made AS (SELECT doc_id, {paragraphs(masked_text('code_quotes'))} AS p FROM prepared),
rows2 AS (SELECT doc_id, unnest(p) AS p, unnest(range(0, len(p))) AS pos FROM made)
SELECT doc_id, CAST(pos AS BIGINT) AS paragraph, CAST(len(regexp_extract_all(p, ';')) AS BIGINT) AS semicolons FROM rows2 WHERE len(regexp_extract_all(p, ';')) >= 2"""


def similar_paragraphs() -> str:
    return f"""WITH {FOLDED},
made AS (SELECT doc_id, list_filter(list_transform({paragraphs(CODE)}, lambda p: list_distinct(regexp_extract_all(lower(p), {q(T.WORD)}, 0))), lambda w: len(w) >= {S.SIMILAR_WORDS}) AS sets FROM prepared),
rows2 AS (SELECT doc_id, unnest(sets) AS own, unnest(range(0, len(sets))) AS pos FROM made),
pairs AS (SELECT b.doc_id, b.pos, a.pos AS earlier, len(list_intersect(a.own, b.own)) AS shared, len(list_distinct(list_concat(a.own, b.own))) AS whole FROM rows2 a JOIN rows2 b ON a.doc_id = b.doc_id AND a.pos < b.pos),
scored AS (SELECT *, round(shared::DOUBLE / whole, 6) AS jaccard FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY jaccard DESC, earlier) AS k FROM scored WHERE jaccard > {S.SIMILAR}::DOUBLE AND shared >= {S.SIMILAR_SHARED})
SELECT doc_id, CAST(pos AS BIGINT) AS paragraph, CAST(earlier AS BIGINT) AS earlier, jaccard, jaccard > {S.DUPLICATE}::DOUBLE AS duplicate FROM best WHERE k = 1"""


LINES = f"{FOLDED}, cuts AS (SELECT doc_id, string_split({CODE}, chr(10)) AS l FROM prepared), lines AS (SELECT doc_id, unnest(l) AS s, CAST(unnest(range(0, len(l))) AS BIGINT) AS line FROM cuts)"


def headings() -> str:
    small = "[" + ", ".join(map(q, S.HEADING_SMALL)) + "]"
    return f"""WITH {LINES},
told AS (SELECT doc_id, line, CAST(length(regexp_extract(s, '^#+', 0)) AS BIGINT) AS level, list_filter(string_split_regex(regexp_replace(s, '^#+\\s+', ''), '\\s+'), lambda w: w <> '') AS w FROM lines WHERE regexp_matches(s, '^#{{1,6}}\\s+\\S')),
tails AS (SELECT *, list_filter(w[2:], lambda x: NOT list_contains({small}, lower(x))) AS tail, lag(level) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM told)
SELECT doc_id, line, level, coalesce(level > before + 1, FALSE) AS skips, len(w) >= 2 AND len(tail) > 0 AND len(list_filter(tail, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 AS title_case FROM tails"""


def numbered_runs() -> str:
    item = q(r"^\s*([0-9]{1,6})[.)]\s+\S")
    return f"""WITH {LINES}, told AS (SELECT doc_id, line, CAST(regexp_extract(s, {item}, 1) AS BIGINT) AS number FROM lines WHERE regexp_matches(s, {item}))
SELECT doc_id, min(line) AS first_line, count(*) AS items FROM told GROUP BY doc_id, line - number HAVING count(*) >= 5"""


def stylometrics() -> str:
    return f"""WITH {FOLDED},
made AS (SELECT doc_id, text, folded, regexp_extract_all(lower(folded), {q(T.WORD)}, 0) AS w, {sentences('folded')} AS s FROM prepared),
told AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(s) AS BIGINT) AS sentences, len(list_distinct(w)) AS d, len(regexp_extract_all(folded, '[.,;:!?]')) AS marks, len(regexp_extract_all(text, '\\S')) AS inked, len(regexp_extract_all(text, {q(S.HAN)})) AS han FROM made)
SELECT doc_id, words, sentences, CASE WHEN sentences > 0 THEN round(words::DOUBLE / sentences, 4) END AS mean_words, CASE WHEN words > 0 THEN round(d::DOUBLE / words, 4) END AS distinct_share, CASE WHEN words > 0 THEN round(marks::DOUBLE / words, 4) END AS punctuation, CASE WHEN inked > 0 AND han::DOUBLE / inked >= 0.1 THEN 'zh-CN' ELSE 'other' END AS locale FROM told"""


def passage_density() -> str:
    return f"""WITH {findings_ctes(measured=False)},
pos AS (SELECT f.doc_id, rule_id, start_pos, CAST(len(regexp_extract_all(substr(s.text, 1, start_pos), {q(r'[^\s]+')})) AS BIGINT) AS word FROM findings f JOIN seeded s USING (doc_id)),
counted AS (SELECT a.doc_id, a.rule_id, a.start_pos, a.word, count(DISTINCT b.rule_id) AS rules FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.word BETWEEN a.word AND a.word + 99 GROUP BY ALL)
SELECT doc_id, count(*) AS places, max(rules) AS most_rules, min(word) AS first_word FROM counted WHERE rules >= 3 GROUP BY doc_id"""
