"""Two texts under one id, and repeated rows, give what the texts give under ids of their own."""

from collections import Counter

import pytest

from inkspan.functions.seeds import TAILS
from inkspan.operators import integrity, pairs, review, score, stats, substance
from inkspan.streaming import scores  # noqa: F401

EVEN = "The first line is here. It goes on and on for some words now. " * 4
TEXTS = [EVEN + tail for tail in TAILS] + [EVEN + TAILS[0], "", None]

OPERATORS = {
    "openers": stats.openers,
    "headings": stats.headings,
    "numbered_runs": stats.numbered_runs,
    "passage_density": stats.passage_density,
    "integrity_findings": integrity.integrity_findings,
    "edit_defects": integrity.edit_defects,
    "repaired": pairs.repaired,
    "score_documents": score.score_documents,
    "decisions": lambda d: review.decisions(score.weighed(score.findings_of(d))),
    "interventions": lambda d: review.interventions(score.weighed(score.findings_of(d))),
}


def told(df, column):
    names = [c for c in df.columns if c not in (column, "row")]
    return Counter(tuple(str(r[c]) for c in names) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents_of_one_id(spark, name):
    apart = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = told(OPERATORS[name](apart), "doc_id")
    for same in (1, None):
        one = spark.createDataFrame([(same, t) for t in TEXTS], "doc_id long, text string").repartition(3)
        assert told(OPERATORS[name](one), "doc_id") == want
    assert want


@pytest.mark.parametrize("name", ["literal_changes", "anchor_changes", "marker_changes", "gate"])
def test_pairs_of_one_id(spark, name):
    operator = {"literal_changes": lambda d: pairs.multiset_changes(d, pairs.LITERALS), "anchor_changes": lambda d: pairs.multiset_changes(d, pairs.ANCHORS), "marker_changes": pairs.marker_changes, "gate": substance.gate}[name]
    sides = [("It must not exceed 45% of all.", "It must exceed 46% of all."), ("It must not exceed 45% of all.", "It must not exceed 45% of all."), ("Same 1.", None), (None, None), ("It always is.", "It often is.")]
    schema = "pair_id long, source string, candidate string"
    want = told(operator(spark.createDataFrame([(i, *s) for i, s in enumerate(sides)], schema)), "pair_id")
    assert told(operator(spark.createDataFrame([(7, *s) for s in sides], schema).repartition(2)), "pair_id") == want and want


def test_many_matches_take_time_in_proportion(spark):
    """Offsets of tens of thousands of matches in one text are exact."""
    from pyspark.sql import functions as F

    from inkspan.functions import text as T

    n = 40_000
    row = spark.createDataFrame([("ab X é 🙂 " * n,)], "text string").select(T.spans(F.col("text"), "X").alias("s")).select(F.size("s").alias("n"), F.col("s")[n - 1].alias("last"), F.col("s")[128].alias("mid")).first()
    assert row.n == n and (row.last.start, row.last.end) == (9 * (n - 1) + 3, 9 * (n - 1) + 4) and row.mid.start == 9 * 128 + 3
