"""Claims, what they rest on, and facts in texts: hand cases and slow counterparts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkspan.operators import claims

SPLITS = [
    ("One. Two! Three", [("One.", 0, 4), ("Two!", 4, 9), ("Three", 9, 15)]),
    ("See a.b and 1.2 now.", [("See a.b and 1.2 now.", 0, 20)]),
    ("今天好。明天好！", [("今天好。", 0, 4), ("明天好！", 4, 8)]),
    ("Wait... what?!", [("Wait...", 0, 7), ("what?", 7, 13), ("!", 13, 14)]),
    ("  ", []),
    ("", []),
    (None, []),
    (".\n.", [(".", 0, 1), (".", 1, 3)]),
]
EVIDENCE = [
    ("The vault flooded twice. Rain fell.", "the vault flooded twice!", "source"),
    ("The vault flooded twice.", "We know the vault flooded.", "experience"),
    ("Rain fell.", "Therefore it held.", "logic"),
    ("Rain fell.", "It may hold.", "inference"),
    ("Rain fell.", "It holds.", "unknown"),
    ("Rain fell.", "I think it may hold, because.", "experience"),
    ("The nodes failed.", "the node", "source"),
    ("The node failed.", "the nod", "unknown"),
    ("The nodes failed.", "the nodes fail", "source"),
    ("Many ponies ran.", "many pony", "source"),
    ("It was saved here.", "it was save", "source"),
    ("Rain, then - snow", "rain then snow", "source"),
    ("Rain_then snow", "rain then snow", "logic"),
    ("a b", "?!", "unknown"),
    (None, "It holds.", "unknown"),
    ("a-it's here", "it's", "source"),
    ("it's a-b-ok", "it's a-b ok", "source"),
    ("it-s a b", "it's a b", "unknown"),
    ("Été froid ici.", "été froid", "source"),
]


def test_splits(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPLITS)], "id long, text string")
    for r in docs.select("id", claims.claims_of(F.col("text")).alias("c")).collect():
        assert [(c.claim, c.start, c.end) for c in r.c] == SPLITS[r.id][1], SPLITS[r.id][0]


def test_evidence(spark):
    pairs = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(EVIDENCE)], "pair_id long, source string, candidate string")
    told = {}
    for r in claims.claim_evidence(pairs).collect():
        told.setdefault(r.pair_id, []).append(r.evidence)
    for i, (source, candidate, want) in enumerate(EVIDENCE):
        assert set(told[i]) == {want}, (source, candidate)
    grounded = {r.pair_id: r for r in claims.grounding(pairs).collect()}
    assert len(grounded) == len(EVIDENCE)
    assert all(grounded[i].grounded == (want in claims.GROUNDED) and (grounded[i].status == "keep") == grounded[i].grounded for i, (_, _, want) in enumerate(EVIDENCE))


def test_candidates_without_claims_are_grounded(spark):
    pairs = spark.createDataFrame([(1, "Rain.", None), (2, None, " "), (2, None, " ")], "pair_id long, source string, candidate string")
    assert [(r.claims, r.grounded) for r in claims.grounding(pairs).collect()] == [(0, True)] * 3
    assert claims.claim_evidence(pairs).count() == 0
    assert claims.grounding(pairs.where("false")).count() == 0


def test_a_claim_of_very_many_words(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["vault", "it's", "a-b", "rain"]) for _ in range(30000))
    rows = [(1, f"Start {text} end.", f"{text}."), (2, f"Start {text} end.", f"{text} rain rain vault it's end end.")]
    told = {r.pair_id: r.evidence for r in claims.claim_evidence(spark.createDataFrame(rows, "pair_id long, source string, candidate string")).collect()}
    assert told == {1: "source", 2: "unknown"}


def slow_split(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c in "。！？!?" or (c == "." and (i + 1 == len(text) or text[i + 1].isspace())):
            out.append((text[start : i + 1].strip(), start, i + 1))
            start = i + 1
    out.append((text[start:].strip(), start, len(text)))
    return [c for c in out if c[0]]


def slow_contains(text, fact):
    words = re.findall(r"\b[\w'-]+\b", fact.lower())
    if not words:
        return False
    last, forms = words[-1], {words[-1]}
    if last.isalpha() and len(last) > 2:
        forms |= {last + e for e in ("s", "ed", "ing")} | ({last + "d"} if last[-1] == "e" else set()) | ({last[:-1] + "ies"} if last[-1] == "y" else set())
    return any(re.search(r"(?<!\w)" + r"[^\w]+".join(map(re.escape, [*words[:-1], form])) + r"(?!\w)", text.lower()) for form in forms)


@pytest.mark.parametrize("seed", [3, 4])
def test_generated_pairs_equal_slow_counterparts(spark, seed):
    rng = random.Random(seed)
    parts = ["plan", "plans", "pony", "ponies", "save", "saved", "it's", "a-b", "'so'", "I", "may", "then", "x_1", "é", ".", ". ", "! ", "。", " ", " ", " ", "\n", "-", "1.5", ", "]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    rows = [(i, text(60), text(25)) for i in range(300)]
    pairs = spark.createDataFrame(rows, "pair_id long, source string, candidate string")
    found = {(r.pair_id, r.claim, r.start_pos, r.end_pos): r.evidence == "source" for r in claims.claim_evidence(pairs).collect()}
    assert found == {(i, *c): slow_contains(s, c[0]) for i, s, t in rows for c in slow_split(t)}
    assert 0 < sum(found.values()) < len(found)
