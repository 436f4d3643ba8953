"""Changes of letters beyond ASCII are changes of a literal or an anchor."""

import pytest

from inkspan.operators import pairs, substance

SWAPS = [
    ('She said "Zürich" here.', 'She said "Zörich" here.', "quoted", '"Zürich"', '"Zörich"'),
    ("Он сказал «да» и “привет мир”.", "Он сказал «да» и “привед мир”.", "quoted", "“привет мир”", "“привед мир”"),
    ("🙂 See https://a.example.com/é now.", "🙂 See https://a.example.com/è now.", "url", "https://a.example.com/é", "https://a.example.com/è"),
    ("漢字 Call `größe` here.", "漢字 Call `grüße` here.", "code", "`größe`", "`grüße`"),
]


@pytest.fixture(scope="module")
def swapped(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(SWAPS)], "pair_id long, source string, candidate string")


def test_changed_foreign_letters_are_told(swapped):
    rows = {tuple(r) for r in pairs.multiset_changes(swapped, pairs.LITERALS).collect()}
    assert rows == {row for i, (_, _, category, lost, gained) in enumerate(SWAPS) for row in ((i, category, lost, 1, 0), (i, category, gained, 0, 1))}


def test_unchanged_foreign_letters_are_not_told(spark):
    same = spark.createDataFrame([(i, a, a) for i, (a, *_) in enumerate(SWAPS)] + [(9, None, "")], "pair_id long, source string, candidate string")
    assert pairs.multiset_changes(same, pairs.LITERALS | pairs.ANCHORS).collect() == []


def test_gate_rejects_changed_foreign_letters(swapped):
    assert {r.decision for r in substance.gate(swapped).collect()} == {"reject"}
