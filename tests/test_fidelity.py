"""The fidelity gate: spans against a slow choice in plain patterns, alignments against a slow one, and hand cases of each decision."""

import random
import re

import pytest

from inkspan.operators import fidelity as Y

PAIRS = "pair_id long, source string, candidate string"
MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
PART = r"[A-Za-z0-9_.\-]"
#: The nine categories in the words of Python's patterns, by priority.
SLOW = [
    ("code_block", r"(?ms)^`{3,}[^\n]*\n.*?^`{3,}[ \t]*$|^~{3,}[^\n]*\n.*?^~{3,}[ \t]*$"),
    ("quoted", r""""[^"\n]*"|'[^'\n]*'|“[^”\n]*”|‘[^’\n]*’|`[^`\n]*`"""),
    ("url", r"""\bhttps?://[^\s<>"']+|\bftp://[^\s<>"']+|\bwww\.[A-Za-z0-9_.\-]+"""),
    ("path", rf"""(?:{PART}+/){{2,}}{PART}*(?:/[^\s<>"']*)?|(?<!{PART})/(?:{PART}+/)*{PART}+|(?<!{PART})(?!(?:and|or|either)/)(?:{PART}+/)+{PART}+|\./[^\s<>"']+|~/[^\s<>"']+|\b[A-Za-z]:[\\/][^\s<>"']+"""),
    ("required_term", r"(?i)\b(?:SOC 2|vault)\b"),
    ("date", rf"(?<![A-Za-z0-9])\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}(?![A-Za-z0-9])|(?<![A-Za-z0-9]){MON}[a-z]*\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\d{{1,2}}(?:st|nd|rd|th)?\s+{MON}[a-z]*\s+\d{{4}}(?![A-Za-z0-9])"),
    ("unit", r"[A-Za-z]+"),
    ("number", r"(?<![A-Za-z0-9.])\d+(?:,\d{3})*(?:\.\d+)?%?"),
    ("operator", r"<=|>=|!=|==|&&|\|\||[+*/]|(?<=\d)-(?=\d)"),
]


def slow_spans(text):
    kept = []
    for category, pattern in SLOW:
        for m in re.finditer(pattern, text):
            if (category != "unit" or m[0].lower() in Y.UNITS) and not any(m.start() < b and a < m.end() for _, a, b, _ in kept):
                kept.append((category, m.start(), m.end(), m[0]))
    return sorted(kept, key=lambda k: k[1])


ATOMS = ["`", "```\n", "~~~\n", '"', "'", "“", "”", "‘", "’", "\n", " ", " ", "https://a.b/c?d=1", "ftp://x/y", "www.e.org", "a/b", "a/b/c", "/tmp/x", "and/or", "and/or/z", "./run", "~/home", "C:\\dir", "x:/y", "../..", "SOC 2", "vault", "2024-01-15", "1/2/2024", "Jan 5th, 2024", "5 March 2021", "10", "ms", "Days", "45%", "1,234.5", "1,2345", "3.", ".5", "v2", "é", "漢", "éms", "<=", ">=", "==", "+", "*", "/", "7-8", "||", "word", "NASA", "not"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_spans_equal_a_slow_choice(spark):
    rows = list(enumerate([*texts(1, 1500), "See `https://a.b/tmp/x` and \"2024-01-15\" in\n```\n/tmp/x 'y\n```\n it's 'q' at https://a.b/c/2024-01-15 10 ms.", "", "9" * 100_000, "a" * 100_000 + "/b"]))
    got = {}
    for r in Y.protected_spans(spark.createDataFrame([*rows, (-1, None)], "doc_id long, text string").repartition(4), ("SOC 2", "vault")).collect():
        got.setdefault(r.doc_id, []).append((r.category, r.start_pos, r.end_pos, r.value))
    for i, text in rows:
        assert sorted(got.get(i, []), key=lambda k: k[1]) == slow_spans(text), text
    assert -1 not in got


def test_anchors_stand_outside_protected_spans(spark):
    text = "It is not \"not here\" and may rise. According to Acme Corp it fell; NASA said so. Don't. We dont know `must`."
    rows = Y.semantic_anchors(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r.start_pos, r.category, r.value) for r in rows) == sorted((text.index(v) if c != "modality" else text.index("may"), c, v) for c, v in [("negation", "not"), ("modality", "may"), ("polarity", "rise"), ("attribution", "According to Acme Corp"), ("polarity", "fell"), ("attribution", "NASA said"), ("name", "NASA"), ("negation", "dont")])


def slow_blocks(a, b, i=0, j=0):
    """Longest common stretches, the earliest first, left and right of each."""
    best = max(((k, -x, -y) for x in range(len(a)) for y in range(len(b)) if (k := next((n for n in range(min(len(a) - x, len(b) - y)) if a[x + n] != b[y + n]), min(len(a) - x, len(b) - y)))), default=(0, 0, 0))
    k, x, y = best[0], -best[1], -best[2]
    if not k:
        return []
    return [*slow_blocks(a[:x], b[:y], i, j), (i + x, j + y, k), *slow_blocks(a[x + k :], b[y + k :], i + x + k, j + y + k)]


def test_alignments_equal_slow_ones():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        codes = Y.opcodes(a, b)
        assert sorted(i for t, i1, i2, *_ in codes if t == "equal" for i in range(i1, i2)) == sorted(x + n for x, _, k in slow_blocks(a, b) for n in range(k))
        for codes in (codes, Y.opcodes(a, b, 0)):
            made = [x for tag, i1, i2, j1, j2 in codes for x in (a[i1:i2] if tag == "equal" else b[j1:j2])]
            assert made == b and [c[1] for c in codes[1:]] == [c[2] for c in codes[:-1]]
            assert all((i1 < i2, j1 < j2) == {"equal": (True, True), "replace": (True, True), "delete": (True, False), "insert": (False, True)}[tag] for tag, i1, i2, j1, j2 in codes)
    assert Y.opcodes(list("x" * 5000), list("x" * 2500 + "y" + "x" * 2499))[1] == ("replace", 2500, 2501, 2500, 2501)
    assert Y.opcodes(list("ab" * 800), list("ab" * 900)) == [("equal", 0, 1600, 0, 1600), ("insert", 1600, 1600, 1600, 1800)]


CASES = [
    ("Deploy time is 40 minutes.", "Deploy time is 50 minutes.", "reject", "number"),
    ("Ships on 2024-01-15.", "Ships on 2024-02-20.", "reject", "date"),
    ("The batch finishes in 10 milliseconds.", "The batch finishes in 10 seconds.", "reject", "unit"),
    ("See https://example.com/guide.", "See https://example.net/guide.", "reject", "url"),
    ("See /tmp/file and docs/file.", "See /tmp/other and docs/other.", "reject", "path"),
    ('The customer wrote "ship it".', 'The customer wrote "ship it now".', "reject", "quoted"),
    ("The service is SOC 2 compliant.", "The service is compliant.", "reject", "required_term"),
    ("Assert x == y here now.", "Assert x != y here now.", "reject", "operator"),
    ("Look:\n```\na = b\n```\nDone with all the long text here.", "Look:\n```\na = c\n```\nDone with all the long text here.", "reject", "code_block"),
    ("This feature is not required for the release.", "This feature is required for the release.", "reject", "negation"),
    ("The system may restart during the update.", "The system will restart during the update.", "reject", "modality"),
    ("The call completes in up to 10 ms.", "The call completes in 10 ms.", "reject", "scope"),
    ("According to NIST, the standard requires encryption.", "According to IETF, the standard requires encryption.", "review", "attribution"),
    ("We delve into the problem, all of it.", "We dig into the problem, all of it.", "accept", None),
    ("Costs are 1,000 in all.", "Costs are 1000 in all.", "accept", None),
    ("A number of things.", "A number of 3 things.", "accept", "number"),
    ("Same.", "Same.", "accept", None),
    (None, None, "accept", None),
    ("Plain words fill a space with prose.", "Wholly other letters, nigh everywhere?", "reject", None),
    ("", None, "accept", None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], PAIRS)


def test_decisions(cases):
    told = {r.pair_id: r for r in Y.gate(cases, terms=("SOC 2",)).collect()}
    kinds = {}
    for r in Y.sequence_changes(cases, ("SOC 2",)).collect():
        kinds.setdefault(r.pair_id, set()).add(r.category)
    for i, (a, b, decision, category) in enumerate(CASES):
        assert told[i].decision == decision, (a, b, told[i])
        assert category is None or category in kinds[i], (a, b)
    assert told[0].hard_failures == 1 and told[18].over_limit and told[16].touched_chars == 0


def test_permissions(spark):
    pairs = spark.createDataFrame([(1, "It cut time by 40% and 40% and 40% there.", "It cut time by 50% and 50% and 50% there."), (2, "Say 7 here again.", "Say 8 here again."), (3, "Say 7 here again.", "Say here again.")], PAIRS)
    grant = lambda *rows: spark.createDataFrame(list(rows), "pair_id long, category string, from_value string, to_value string")
    some = grant((1, "number", None, "50"), (2, "number", "9", None), (3, "number", None, None), (2, "date", None, None))
    assert {r.pair_id: (r.decision, r.authorised) for r in Y.gate(pairs, permissions=some).collect()} == {1: ("accept", 3), 2: ("reject", 0), 3: ("reject", 0)}
    assert sorted((r.pair_id, r.authorised) for r in Y.authorised(pairs, some).collect()) == [(1, True)] * 3 + [(2, False), (3, False)]
    changes = Y.sequence_changes(pairs)
    left = lambda *rows: sorted((r.pair_id, r.authorised) for r in Y.authorised_once(changes, grant(*rows)).collect())
    assert left((1, "number", "40%", "50%"), (1, "number", None, None)) == [(1, False), (1, True), (1, True), (2, False), (3, False)]
    assert left((1, "number", "40%", None), (1, "number", None, "50%"), (1, "number", "", ""), (1, "number", None, None), (2, "number", "7", "9"), (3, "number", None, None)) == [(1, True)] * 3 + [(2, False), (3, False)]


def test_zones_and_churn(spark):
    source = "We delve into the problem. " + "The deployment pipeline handles releases regularly. " * 10
    other = "We delve into the problem. " + "Plain words fill this space with ordinary prose across the document. " * 10
    pairs = spark.createDataFrame([(1, source, other), (2, source, source.replace("delve", "dig")), (2, source, source.replace("delve", "dig"))], PAIRS)
    zones = spark.createDataFrame([(1, 3, 8), (2, 3, 8)], "pair_id long, start_pos long, end_pos long")
    told = sorted((r.pair_id, r.decision, r.over_limit, r.over_justified) for r in Y.gate(pairs, zones, churn_limit=0.1).collect())
    assert told == [(1, "reject", True, True), (2, "accept", False, False), (2, "accept", False, False)]


def test_no_pairs(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert Y.gate(empty).collect() == Y.sequence_changes(empty).collect() == Y.churn(empty).collect() == []
