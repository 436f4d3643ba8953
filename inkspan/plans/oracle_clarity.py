"""The clarity review in SQL over the plain tables."""

from __future__ import annotations

from ..functions import text as T
from ..functions.seeds import seeded_sql
from ..operators import clarity, detect
from . import oracle
from .oracle_measured import listed, q

#: What is put after the seeded texts: gaps, restated headings, quoted and evidenced claims.
TAILS = (
    "\nOne client on the northern line saw a failure. This matters. Some teams once learned it.",
    "\n## Storage limits here\nThe storage limit of a node is set.\n\n# Weather\nRain.\n",
    '\nThey say "we utilize — and delve" there. It is crucial. The stakes are high. A vendor reported "a robust incident".',
    "\nThe change is crucial because we measured 40% less. In order to win, a team had to leverage it. It results in chaos. `In order to`\n### Overview of plans\nAn overview is planned.",
    "",
)
TEXT = f"({seeded_sql()}) || CASE doc_id % 5 " + " ".join(f"WHEN {n} THEN {oracle_tail}" for n, oracle_tail in ((n, " || chr(10) || ".join(q(part) for part in tail.split("\n"))) for n, tail in enumerate(TAILS))) + " END"
MEDIUM = "CASE doc_id % 7 " + " ".join(f"WHEN {n} THEN '{m}'" for n, m in enumerate(clarity.MEDIUMS)) + " END"


def _restated() -> str:
    words = lambda t: f"list_distinct(regexp_extract_all(lower({t}), {q(T.WORD)}, 0))"
    said = words(f"regexp_replace(substr(text, start_pos + 1, end_pos - start_pos), {q('^#{1,6}' + chr(92) + 's*')}, '')")
    line = f"substr(split_part(regexp_replace(substr(text, end_pos + 1, {detect.RESTATED_WITHIN}), '^\\n+', ''), chr(10) || chr(10), 1), 1, {detect.RESTATED_LINE})"
    shared = f"len(list_filter({said}, lambda w: length(w) >= {detect.RESTATED_WORD} AND len(list_filter({words(line)}, lambda c: starts_with(c, w) OR starts_with(w, c))) > 0))"
    return f"NOT ({shared} > 0 AND 2 * {shared} >= len({said}))"


def _ctes() -> str:
    own = ",\n".join(oracle.spans(f"c_{d.key}", "prepared", "folded", d.key, d.signal, d.pattern, "TRUE", _restated() if d.restated else oracle.excused(d)) for d in clarity.FINDERS)
    both = oracle.findings_ctes().replace(oracle.SEEDED, f"seeded AS (SELECT doc_id, {TEXT} AS text FROM documents)")
    kinds = " ".join(f"WHEN '{key}' THEN '{kind}'" for key, (kind, _) in clarity.OWN.items())
    reported = " ".join(f"WHEN '{key}' THEN '{rule}'" for key, (_, rule) in clarity.OWN.items())
    relaxed = " OR ".join(f"(medium = '{m}' AND rule IN ({', '.join(map(q, rules))}))" for m, rules in clarity.MEDIUM_RELAX.items())
    asked = " ".join(f"WHEN {q(key)} THEN {q(text)}" for key, text in clarity.QUESTIONS.items())
    touch = lambda kind: f"EXISTS (SELECT 1 FROM kinds o WHERE o.doc_id = k.doc_id AND o.kind = '{kind}' AND o.start_pos < k.reach AND k.start_pos < o.reach)"
    return f"""{both},
{own},
every AS (SELECT * FROM findings WHERE rule_id NOT LIKE 'mechanism-%' UNION ALL {oracle.union([f'c_{d.key}' for d in clarity.FINDERS])}),
kinds AS (SELECT *, CASE rule_id {kinds} ELSE 'scored' END AS kind, CASE WHEN evidence = 'document' THEN start_pos + {clarity.DEFAULT_LENGTH} ELSE end_pos END AS reach FROM every),
seen AS (SELECT k.*, {touch('quotation')} AS quoted, {touch('scored')} AS covered, EXISTS (SELECT 1 FROM kinds o WHERE o.doc_id = k.doc_id AND o.kind = 'bare' AND o.rule_id = replace(k.rule_id, 'claim_', 'bare_') AND o.start_pos = k.start_pos) AS bare FROM kinds k),
kept AS (SELECT * FROM seen WHERE NOT (kind IN ('quotation', 'bare') OR (kind = 'gap' AND covered))),
dashed AS (SELECT * FROM kept UNION ALL SELECT * REPLACE ('dash' AS kind) FROM kept WHERE rule_id = 'fmt-em-dash'),
rated AS (SELECT d.*, CASE d.rule_id {reported} ELSE d.rule_id END AS rule, r.category, r.review, {MEDIUM} AS medium FROM dashed d LEFT JOIN registry r USING (rule_id)),
stated AS (SELECT *, CASE kind WHEN 'gap' THEN 'ask-author' WHEN 'dash' THEN 'revise' WHEN 'header' THEN CASE WHEN medium IN ('reference', 'guide') THEN 'keep' ELSE 'revise' END
 WHEN 'claim' THEN CASE WHEN medium IN ('evocation', 'narrative') OR NOT bare THEN 'keep' ELSE 'ask-author' END
 ELSE CASE WHEN rule_id = 'struct-unsourced-precision' THEN 'ask-author' WHEN category IS NULL THEN 'revise' WHEN quoted THEN 'keep' WHEN list_contains({listed(clarity.CUT_RULES)}, rule_id) OR category IN ('filler', 'chatbot') THEN 'cut' WHEN review <> 'deterministic' AND ({relaxed}) THEN 'keep' ELSE 'revise' END END AS status FROM rated),
told AS (SELECT doc_id, medium, rule AS rule_id, kind, status, start_pos, end_pos, CASE WHEN status = 'ask-author' THEN CASE rule_id {asked} END END AS question FROM stated)"""


def clarity_findings() -> str:
    return f"WITH {_ctes()}\nSELECT * FROM told"


def clarity_decisions() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.replace('-', '_')}" for s in ("keep", "revise", "cut", "ask-author"))
    return f"""WITH {_ctes()},
counted AS (SELECT doc_id, {counts}, count(question) AS questions FROM told GROUP BY doc_id)
SELECT s.doc_id, {MEDIUM} AS medium, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('keep', 'revise', 'cut', 'ask_author', 'questions'))}, CASE WHEN ask_author > 0 THEN 'ask-author' WHEN cut > 0 THEN 'cut' WHEN revise > 0 THEN 'revise' WHEN keep > 0 THEN 'keep' ELSE 'no-finding' END AS decision
FROM seeded s LEFT JOIN counted USING (doc_id)"""
