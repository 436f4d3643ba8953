"""Clarity reviews: cases written by hand of each kind and status, and a slow count of what a heading's line says again."""

import random
import re

import pytest

from inkspan.operators import clarity, detect

#: Text, medium, and (rule, kind, status) of every finding.
CASES = [
    ("One client saw a failure there.", "argument", [("struct-specificity-theater", "gap", "ask-author")]),
    ("Some teams saw it.", "argument", []),
    ("This matters.", "message", [("struct-empty-declaratives", "gap", "ask-author")]),
    ("The stakes are high for it.", "narrative", [("struct-empty-declaratives", "gap", "ask-author")]),
    ("We utilize it.", "argument", [("vocab-utilize", "scored", "revise")]),
    ('He said "we utilize it" then.', "argument", [("vocab-utilize", "scored", "keep")]),
    ("He said “we utilize it” then.", "argument", [("fmt-curly-quotes", "scored", "keep"), ("fmt-curly-quotes", "scored", "keep"), ("vocab-utilize", "scored", "keep")]),
    ("In order to win we ran.", "argument", [("filler-in-order", "scored", "cut")]),
    ("It ran — then sat.", "evocation", [("fmt-em-dash", "scored", "revise"), ("fmt-em-dash", "dash", "revise")]),
    ('It "ran — then" sat.', "evocation", [("fmt-em-dash", "scored", "keep"), ("fmt-em-dash", "dash", "revise")]),
    ("It results in chaos.", "argument", [("mechanism-causality", "claim", "ask-author")]),
    ("It results in chaos.", "narrative", [("mechanism-causality", "claim", "keep")]),
    ("It results in 40% less, we measured.", "argument", [("mechanism-causality", "claim", "keep")]),
    ("`It results in chaos.`", "argument", [("mechanism-causality", "claim", "ask-author")]),
    ("# Storage limits\nThe storage has limits.", "argument", [("struct-fragmented-headers", "header", "revise")]),
    ("# Storage limits\nThe storage has limits.", "reference", [("struct-fragmented-headers", "header", "keep")]),
    ("# Storage limits\nThe storage has limits.", "guide", [("struct-fragmented-headers", "header", "keep")]),
    ("# Weather\nRain fell.", "argument", []),
    ("# Café menus\n\nCafé menus vary.", "argument", [("struct-fragmented-headers", "header", "revise")]),
    ("Adoption is 45% here.", "argument", [("struct-unsourced-precision", "scored", "ask-author")]),
    ('"Adoption is 45% here."', "evocation", [("struct-unsourced-precision", "scored", "ask-author")]),
    ("The rain fell.", "argument", []),
    ("", "argument", []),
    (None, "argument", []),
    ("This matters.", "poem", []),
    ("This matters.", None, []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(CASES)], "doc_id long, text string, medium string")


def test_findings_of_each_status(docs):
    found = clarity.clarity_findings(docs).collect()
    for i, (text, medium, want) in enumerate(CASES):
        assert sorted((r.rule_id, r.kind, r.status) for r in found if r.doc_id == i) == sorted(want), (text, medium)
    assert all((r.question is not None) == (r.status == "ask-author") for r in found)


def test_decisions(docs):
    told = {r.doc_id: r for r in clarity.clarity_decisions(docs).collect()}
    assert len(told) == len(CASES)
    rank = ["keep", "revise", "cut", "ask-author"]
    for i, (_, medium, want) in enumerate(CASES):
        if medium not in clarity.MEDIUMS:
            assert told[i].decision == clarity.UNKNOWN_MEDIUM and told[i].revise == 0
            continue
        statuses = [s for _, _, s in want]
        assert told[i].decision == (max(statuses, key=rank.index) if statuses else "no-finding")
        assert [told[i].keep, told[i].revise, told[i].cut, told[i].ask_author] == [statuses.count(s) for s in rank]


def test_gap_that_a_scored_finding_covers_is_left_out(spark):
    docs = spark.createDataFrame([(1, "A team had to utilize it, and caused pain.", "argument"), (2, "A team quite had it. We utilize it.", "argument")], "doc_id long, text string, medium string")
    found = {(r.doc_id, r.kind) for r in clarity.clarity_findings(docs).collect()}
    assert (2, "gap") in found and (2, "scored") in found
    text, at = "A team had to utilize it, and caused pain.", clarity.VAGUE_EXAMPLE
    gap, scored = re.search(at, text).span(), re.search("utilize", text).span()
    assert ((1, "gap") in found) == (not (gap[0] < scored[1] and scored[0] < gap[1]))


def test_rows_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "This matters.", "argument"), (1, "Rain.", "argument"), (1, "This matters.", "argument")], "doc_id long, text string, medium string")
    assert sorted(r.decision for r in clarity.clarity_decisions(docs).collect()) == ["ask-author", "ask-author", "no-finding"]
    assert clarity.clarity_findings(docs).count() == 2


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, medium string")
    assert clarity.clarity_findings(docs).count() == clarity.clarity_decisions(docs).count() == 0


def test_restated_headings_equal_a_slow_count(spark):
    rng = random.Random(5)
    vocabulary = ["plan", "plans", "planning", "a", "of", "storage", "store", "it's", "the", "rain", "rainfall", "x1"]
    texts = []
    for _ in range(150):
        line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        texts.append("".join(f"{'#' * rng.randint(1, 7)} {line(rng.randint(1, 4))}{rng.choice([chr(10), chr(10) * 3, ''])}{line(rng.randint(0, 40))}{rng.choice([chr(10), chr(10) * 2])}" for _ in range(3)))

    def slow(text):
        out = []
        for m in re.finditer(r"(?m)^#{1,6}\s+[^\n]+$", text):
            words = set(re.findall(r"[a-z0-9']+", m.group().lower().lstrip("#")))
            line = text[m.end() : m.end() + 200].lstrip("\n").split("\n\n")[0][:140]
            again = re.findall(r"[a-z0-9']+", line.lower())
            shared = sum(len(w) >= 4 and any(c.startswith(w) or w.startswith(c) for c in again) for w in words)
            if shared and shared / len(words) >= 0.5:
                out.append((m.start(), m.end()))
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    header = next(d for d in clarity.FINDERS if d.key == "fragmented_header")
    found = {(r.doc_id, r.start_pos, r.end_pos) for r in detect.found_in(docs, [header]).collect()}
    assert found == {(i, *p) for i, t in enumerate(texts) for p in slow(t)} and found


def test_many_findings_of_one_text(spark):
    docs = spark.createDataFrame([(1, 'We utilize "it". ' * 5000, "argument")], "doc_id long, text string, medium string")
    assert clarity.clarity_decisions(docs).first().revise >= 5000
