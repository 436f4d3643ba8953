"""Document-level detectors on hand-written texts: what each finds, where, and what it leaves alone."""

import pytest

from inkspan.operators import detect, score

SAME = "The harbour crew counted forty crates of oranges before the morning tide came in"
LIKE = "The harbour crew counted forty crates of lemons before the evening tide came in again"
PASSIVE = " ".join(f"The {n} was closed by the guard." for n in ("gate", "door", "lid", "vault", "hatch", "shop"))
ACTIVE = " ".join(f"The guard closed the {n}." for n in ("gate", "door", "lid", "vault", "hatch", "shop"))
EVEN = " ".join(f"Crew {n} carried thirteen long wooden planks across the wet northern harbour yard." for n in "abcde")
PARAGRAPH = " ".join(["plank"] * 31)

CASES = [
    ("struct-paragraph-duplication", f"{SAME}.\n\nOther words.\n\n{SAME}!", [f"{SAME}!"]),
    ("struct-paragraph-duplication", f"{SAME}.\n\n{LIKE}.", []),
    ("struct-paragraph-duplication", f"{SAME}.\n# Next part\n{SAME}.", []),
    ("struct-paragraph-duplication", f"- {SAME}.\n\n- {SAME}.", []),
    # the first accuses the second, which accuses none; the third is left
    ("struct-paragraph-duplication", f"{SAME}.\n\n{SAME}!\n\n{SAME}?", [f"{SAME}!"]),
    ("struct-paragraph-similarity", f"{SAME}.\n\n{LIKE}.", [f"{LIKE}."]),
    ("struct-paragraph-similarity", f"{SAME}.\n\nNothing here is like what went before it at all.", []),
    ("struct-passive-density", PASSIVE, [None]),
    ("struct-passive-density", ACTIVE, []),
    ("struct-passive-density", f"```\n{PASSIVE}\n```", []),
    ("struct-passive-density", f"# One\n{PASSIVE}\n# Two\n{ACTIVE}\n# Three\n{PASSIVE}", [None, None]),
    ("fmt-title-case", "## The Quick Brown Fox\nbody", ["## The Quick Brown Fox"]),
    ("fmt-title-case", "## The quick brown fox\nbody", []),
    ("fmt-title-case", "## Using Python and Kubernetes\nbody", []),
    ("fmt-title-case", "```\n## The Quick Brown Fox\n```", []),
    ("struct-sentence-length-variance", EVEN, [None]),
    ("struct-sentence-length-variance", EVEN + " It ended.  " + "Now we rest and sleep. " * 9, []),
    ("struct-paragraph-length-variance", "\n\n".join([PARAGRAPH] * 4), [None]),
    ("struct-paragraph-length-variance", "\n\n".join([PARAGRAPH] * 3), []),
    ("struct-sentence-start-repetition", "We ran far. We sat down. We ate bread. They left. He came. She spoke.", [None]),
    ("struct-sentence-start-repetition", "We ran far. You sat down. I ate bread. They left. He came. She spoke.", []),
    ("struct-transition-repetition", "Moreover it is. Moreover it was. Moreover it will be.", [None]),
    ("struct-transition-repetition", "Moreover it is. Moreover it was. Hence it will be.", []),
    ("fmt-semicolon", "\n\nOne; two; three.\n\nFour; five.\n", [None]),
    ("struct-heading-hierarchy", "# A b\n### C d\n", ["### C d"]),
    ("struct-heading-hierarchy", "# A b\n## C d\n# E f\n", []),
]


@pytest.fixture(scope="module")
def found(spark):
    """One row of each text; the number of the case stands for its id."""
    docs = spark.createDataFrame([(n, text) for n, (_, text, _) in enumerate(CASES)] + [(-1, None), (-2, "")], "doc_id long, text string")
    return detect.measured_findings(docs).collect()


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases(found, n):
    rule, text, want = CASES[n]
    got = sorted((r for r in found if r.doc_id == n and r.rule_id == rule), key=lambda r: r.start_pos)
    assert [r.value for r in got] == want
    for r in got:
        assert 0 <= r.start_pos < r.end_pos <= len(text) and (r.evidence == "document") == (r.value is None)
        assert r.value in (None, text[r.start_pos : r.end_pos])


def test_empty_and_null_texts_have_none(found):
    assert not [r for r in found if r.doc_id < 0]


def test_semicolons_point_to_the_paragraph_without_blank_lines(found):
    n = next(i for i, c in enumerate(CASES) if c[0] == "fmt-semicolon")
    assert [(r.start_pos, r.end_pos) for r in found if r.doc_id == n and r.rule_id == "fmt-semicolon"] == [(2, 18)]


def test_a_section_does_not_take_in_the_phrases_inside_it(spark):
    """A strict document finding and a strict span in its section are both scored; a repeated section weighs half."""
    docs = spark.createDataFrame([(1, PASSIVE + " We utilize it."), (2, PASSIVE)], "doc_id long, text string")
    rows = {r.doc_id: r for r in score.score_documents(docs).collect()}
    assert rows[2].penalty == 4.0 and rows[1].penalty > rows[2].penalty
