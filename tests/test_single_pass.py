"""Findings are worked out once for each query, and texts are looked through without being cut into words."""

import re

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import calibration, detect, review, score
from inkspan.plans.queries import OPERATORS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["agreement", "pooled_rates", "expected_findings", "absent_findings", "clean_span_hits"])
def test_findings_are_made_once(spark, sf_dir, name):
    assert plan(OPERATORS[name][0](spark, sf_dir)).count("explode(_rules#") == 1


def test_rates_read_written_findings(spark, sf_dir):
    assert "explode(_rules#" not in plan(OPERATORS["detection_rates"][0](spark, sf_dir))


def test_words_are_looked_up_in_place(spark):
    rows = spark.createDataFrame([(1, "Delve into the robust plan.")], "doc_id long, text string")
    assert "split(" not in re.search(r"array_distinct\(.*?AS _held|.*AS _held", plan(detect.lexical_findings(rows)))[0].split(" AS _lower")[-1]


def test_agreement_of_ranks(spark):
    rows = spark.createDataFrame([(90, 100), (90, 100), (80, 0), (95, 0), (100, 100), (70, None)], "score long, target int")
    got = review.agreement(rows).first()
    # Ranks of the scores 3.5, 3.5, 2, 5, 6 (of six rows); those of the targets with the null first
    x, y = [3.5, 3.5, 2, 5, 6], [5, 5, 2.5, 2.5, 5]
    mx, my = sum(x) / 5, sum(y) / 5
    rank = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert (got.documents, got.mean_absolute_error, got.spearman) == (5, round((10 + 10 + 80 + 95 + 0) / 5, 4), round(rank, 4))
    none = review.agreement(rows.where("score > 100")).first()
    assert (none.documents, none.mean_absolute_error, none.spearman) == (0, None, None)


def test_expected_places(spark):
    labels = spark.createDataFrame([(1, "a", "x", 0, 5), (1, "a", "x", 1, 5), (1, "b", "x", 0, 5), (1, "a", "y", None, 5), (None, "a", "x", 0, 5)], "doc_id long, rule_id string, category string, start_pos long, end_pos long")
    found = spark.createDataFrame([(1, "a", "x", 0, 5), (1, "a", "x", 0, 5), (1, "a", "x", 9, 12)], labels.schema)
    got = [(r.rule_id, r.start_pos, r.found, r.exact, r.category_match) for r in calibration.expected_findings(labels, found).collect()]
    assert sorted(got, key=str) == sorted([("a", 0, True, True, True), ("a", 1, True, False, True), ("b", 0, False, False, True), ("a", None, True, False, False), ("a", 0, False, False, True)], key=str)


def test_words_that_branch(spark):
    words = ["end", "ends", "ending", "a_b", "delve"]
    texts = ["the end ends, ending! send endx a_b a_b_ delve", "", "end", "ende\nend", "x end٣ é end"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.select(F.regexp_extract_all("text", F.lit(T.any_word(words)), F.lit(0))).collect()]
    assert got == [[w for w in re.split("[^a-z0-9_]+", t) if w in words] for t in texts]


def test_patterns_of_spans_wait_for_their_signs(spark):
    from inkspan.operators import fidelity

    told = fidelity.protected_candidates("t")
    assert all(likely.replace("%s", "t") in told for likely in fidelity.LIKELY.values())
    texts = ["x ٣ and ٤", "C:\\x", "see www.a.b", "2024-03-05", "~~~\na\n~~~", "none of it", "5 kms 5 KM", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.category, r.value) for r in fidelity.protected_spans(rows).collect())
    assert {(0, "number", "٣"), (0, "number", "٤"), (1, "path", "C:\\x"), (2, "url", "www.a.b"), (3, "date", "2024-03-05"), (4, "code_block", "~~~\na\n~~~"), (6, "number", "5"), (6, "unit", "KM")} <= set(got)
    assert {g for g in got if g[0] in (5, 7)} == set()
