"""Patterns as Spark gets them match what they match as written, and nothing is looked for more often than asked."""

import re

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import detect, pairs
from inkspan.plans.queries import OPERATORS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pattern", [r"[A-Za-z0-9']+", r"[^a-f\n]{2}", r"[]a-c-]+", r"\[[^\]a-z]*\]", r"(?i)[k-m]\w", r"\x61[0-9]?", r"x-z[+-9]"])
def test_listed_ranges(pattern):
    text = "kLm [A] ab-]c x-z+ a1 é9'Z\n[z] ~"
    assert re.findall(T.quick(pattern), text) == re.findall(pattern, text)


def test_listed_patterns_have_no_letter_ranges():
    assert not re.search(r"[a-y]-[b-z](?![^\[]*\()", T.quick(r"[A-Za-z0-9_]\b[a-z]"))
    assert T.quick(r"[\x00-\x7F\P{L}]") == r"[\x00-\x7F\P{L}]"


def test_heads_lose_no_match(spark):
    """Each pattern finds behind a look at its first letter what it finds without it."""
    asked = [(d.pattern, d.heads) for d in (*detect.lexical(), *detect.DETECTORS)] + [(p, pairs.HEADS.get(c, "")) for c, p in (pairs.ANCHORS | pairs.LITERALS).items()]
    words = sorted({w for p, _ in asked for w in re.findall(r"[A-Za-z]+(?:[' -][A-Za-z]+)*", re.sub(r"\\.|\?|\[[^]]*\]", " ", p))})
    text = ". ".join(words) + ". " + ". ".join(w.upper() for w in words) + " 45% 3 of 4 2024-03-05 https://a.b 5 May 2021 12 users. As an industry leader we're proud"
    row = spark.createDataFrame([(text,)], "text string")
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    got = row.select(*[F.array(count(p), count(T.beginning(h, T.quick(p)))) for p, h in asked if h]).first()
    assert all(a == b for a, b in got)
    assert sum(a > 0 for a, _ in got) > len(got) / 2


@pytest.mark.parametrize("name", ["grouped_findings", "clean_span_hits", "category_rollup", "smallest_spans", "carried_offsets", "absent_findings", "pattern_findings"])
def test_findings_are_not_made_to_be_counted(spark, sf_dir, name):
    """No filter before an explode finds the places of matches once more."""
    assert not [line for line in plan(OPERATORS[name][0](spark, sf_dir)).split("\n") if re.match(r"\W*Filter", line) and "aggregate(" in line]


@pytest.mark.parametrize("name", ["anchor_changes", "literal_changes"])
def test_values_are_not_looked_for_to_be_counted(spark, sf_dir, name):
    assert not [line for line in plan(OPERATORS[name][0](spark, sf_dir)).split("\n") if re.match(r"\W*Filter", line) and "regexp_replace(" in line]


def test_equal_sides_are_accepted(spark):
    from inkspan.operators import substance

    rows = spark.createDataFrame([(1, "not 5 km", "not 5 km"), (1, "not 5 km", "5 km"), (2, None, ""), (3, "é must ３ not", "é must not"), (4, "NASA", "ESA")], "pair_id long, source string, candidate string")
    assert sorted(map(tuple, substance.gate(rows).collect())) == [(1, "accept", 0), (1, "reject", 1), (2, "accept", 0), (3, "accept", 0), (4, "review", 2)]
    got = sorted(map(tuple, pairs.multiset_changes(rows, pairs.ANCHORS).collect()))
    assert got == [(1, "negation", "not", 1, 0), (4, "name", "ESA", 0, 1), (4, "name", "NASA", 1, 0)]
