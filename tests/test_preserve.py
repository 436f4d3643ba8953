"""Pairs by hand for each check of literal preservation."""

import pytest

from inkspan.operators import preserve

KEPT = [
    ("a\n", "b\n"),
    ("See https://a.example.com/p?utm_source=chatgpt.com.", "Look at https://a.example.com/p"),
    ("See https://a.example.com/p?id=3&ref=openai&x=1#y", "See https://a.example.com/p?id=3&x=1#y"),
    ("Of 12, 7 left.", "7 of 12 left."),
    ("Say and/or.", "Say either/or."),
    ("", None),
]
CHANGED = [
    ("---\na: 1\n---\nx", "---\na: 2\n---\nx", "frontmatter-modified"),
    ("```py\nx\n```\n", "```py\ny\n```\n", "code-block-modified"),
    ("~~~\nx\n~~~\n", "x\n", "code-block-modified"),
    ("> said he\n> and she\n\nx", "> said he\n\nx", "blockquote-modified"),
    ("Use `a` and `b`.", "Use `b` and `a`.", "inline-code-modified"),
    ("| a | b |\n|---|---|\n", "| a | c |\n|---|---|\n", "table-modified"),
    ("See https://a.example.com/p?id=x", "See https://a.example.com/p", "url-modified"),
    ("See www.example.com now", "See it now", "url-modified"),
    ("It is 45% now.", "It is 46% now.", "numeric-literal-modified"),
    ("Of 7 and 7.", "Of 7.", "numeric-literal-modified"),
    ('He said "yes".', 'He said "no".', "quotation-modified"),
    ("By Ada Byron\n\nx", "x", "attribution-modified"),
    ("Open /etc/hosts first.", "Open /etc/passwd first.", "path-modified"),
    ("Open src/a/b.py first.", "Open src/a/c.py first.", "path-modified"),
    ("# One\n\n## Two\n", "## Two\n\n# One\n", "heading-modified"),
]


def judged(spark, rows):
    frame = spark.createDataFrame([(1, a, b) for a, b in rows], "pair_id long, source string, candidate string")
    return [(r.status, r.errors) for r in preserve.preservation(frame.coalesce(1)).collect()]


def test_what_is_kept_passes(spark):
    assert judged(spark, KEPT) == [("literal_preservation_passed", "")] * len(KEPT)
    assert judged(spark, [(a, a) for a, *_ in CHANGED]) == [("literal_preservation_passed", "")] * len(CHANGED)


def test_what_is_lost_is_told(spark):
    for (source, candidate, code), (status, errors) in zip(CHANGED, judged(spark, [c[:2] for c in CHANGED]), strict=True):
        assert status == "preservation_failed" and errors == code, (source, candidate, errors)


@pytest.mark.parametrize("side", [0, 1])
def test_long_sides(spark, side):
    pair = ["word 1. " * 50_000, "word 1. " * 50_000]
    pair[side] += "2"
    assert judged(spark, [tuple(pair)]) == [("preservation_failed", "numeric-literal-modified")]
