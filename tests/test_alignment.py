"""Alignments of any size: the standard library's on generated sequences, and decisions that no size changes."""

import difflib
import random

import pytest

from inkspan.functions import alignment
from inkspan.operators import fidelity


def edited(rng, items):
    """A copy with stretches dropped, put in, said again and moved."""
    out = list(items)
    for _ in range(rng.randrange(6)):
        p, q = rng.randrange(len(out) + 1), rng.randrange(len(out) + 1)
        turn = rng.randrange(4)
        stretch = out[q : q + 20]
        if turn == 0:
            out[p : p + 4] = []
        elif turn == 1:
            out[p:p] = [rng.choice("abcxyz ") for _ in range(rng.randrange(6))]
        elif turn == 2:
            out[p:p] = stretch
        else:
            out[q : q + 20] = []
            out[p:p] = stretch
    return out


@pytest.mark.parametrize("few, most", [(0, 50), (0, alignment.MOST_RUNS), (40, 50), (alignment.FEW_CELLS, alignment.MOST_RUNS)])
def test_alignments_equal_the_standard_library(monkeypatch, few, most):
    monkeypatch.setattr(alignment, "FEW_CELLS", few)
    monkeypatch.setattr(alignment, "MOST_RUNS", most)
    rng = random.Random(few + most)
    for n in range(500):
        letters = rng.choice(["ab", "abc", "abcdefghij", "a", "etaoin shrdlu"])
        a = [rng.choice(letters) for _ in range(rng.randrange(120))] * rng.choice([1, 1, 3])
        b = edited(rng, a) if n % 3 else [rng.choice(letters) for _ in range(rng.randrange(120))]
        if n % 4 == 1:
            a, b = a * 2 + a[:20], a * 2 + b[:20]
        a, b = (a, b) if n % 2 else ("".join(a), "".join(b))
        assert alignment.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def test_long_sequences_of_few_letters():
    assert alignment.opcodes("x" * 5000, "x" * 2500 + "y" + "x" * 2499) == [("equal", 0, 2500, 0, 2500), ("insert", 2500, 2500, 2500, 2501), ("equal", 2500, 4999, 2501, 5000), ("delete", 4999, 5000, 5000, 5000)]


def test_no_size_changes_what_an_edit_touches(spark):
    """Two words put in, far apart: as many characters in a text of any length, and no reason to reject a long one."""
    rows = [(n, body, f"New {body[: len(body) // 2]} also{body[len(body) // 2 :]}") for n in (10, 40, 400) for body in ["".join(f"Plain words numbered w{i * 7919 % 10007}x fill the line. " for i in range(n))]]
    pairs = spark.createDataFrame(rows, "pair_id long, source string, candidate string")
    assert {r.pair_id: r.touched_chars for r in fidelity.churn(pairs).collect()} == {10: 9, 40: 9, 400: 9}
    assert {r.decision for r in fidelity.gate(pairs).collect()} == {"accept"}


def test_no_size_changes_how_values_align(spark):
    """A number put in before 1,200 others is one that was added; no other has changed."""
    numbers = " ".join(str(i) for i in range(1000, 2200))
    pairs = spark.createDataFrame([(1, numbers, f"7 {numbers} 8")], "pair_id long, source string, candidate string")
    assert sorted((r.change, r.candidate_value) for r in fidelity.sequence_changes(pairs).collect()) == [("added", "7"), ("added", "8")]
