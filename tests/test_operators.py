"""Small cases with known results, and edge rows."""

import re

import pytest

from inkspan.functions import rules
from inkspan.functions import text as T
from inkspan.operators import corpus, detect, integrity, pairs, review, score, stats

DOCS = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_spans_match_finditer(spark):
    from pyspark.sql import functions as F

    texts = ["", "aXbXXc", "é🙂X \nX", "none", "X"]
    rows = docs(spark, *texts).select("text", T.spans(F.col("text"), "X+").alias("s")).collect()
    assert [[(x.start, x.end, x.value) for x in r.s] for r in rows] == [[(m.start(), m.end(), m[0]) for m in re.finditer("X+", t)] for t in texts]


def test_masks_keep_offsets(spark):
    from pyspark.sql import functions as F

    text = 'a `b` "c d" e\n```\nf\n```\ng'
    masked = docs(spark, text).select(T.mask_code_and_quotes(F.col("text"))).first()[0]
    assert len(masked) == len(text) and masked.split() == ["a", "e", "g"]


def test_profiles():
    assert rules.closure("technical") == ("technical", "general")
    assert {r.rule_id for r in rules.active("general")} - {r.rule_id for r in rules.active("technical")} == {"vocab-robust", "vocab-significant"}
    with pytest.raises(ValueError, match="no profile"):
        rules.closure("none")


def test_inflections():
    assert {"utilizes", "utilized", "utilizing"} <= set(rules.inflections("utilize"))
    assert rules.inflections("cutting-edge") == ["cutting-edge"]


@pytest.mark.parametrize(("hits", "words", "expected"), [(1, 500, 92), (2, 500, 88), (3, 750, 91), (20, 500, 76)])
def test_published_scores(spark, hits, words, expected):
    """One high rule: full weight, then half, then quarters, three times the weight at most."""
    text = " ".join(["utilize"] * hits + ["word"] * (words - hits))
    d = docs(spark, text)
    assert score.score_documents(d, detect.all_findings(d)).first().score == expected


def test_overlaps_have_one_primary(spark):
    d = docs(spark, "We are agile.")
    rows = score.overlap_groups(detect.lexical_findings(d)).collect()
    assert {r.rule_id for r in rows} == {"vocab-agile", "phrase-agile-adaptation"}
    assert [r.rule_id for r in rows if r.is_primary] == ["vocab-agile"]


def test_quotes_and_code_are_no_findings(spark):
    d = docs(spark, 'Say "wow!" and `a!` now!')
    assert [(r.start_pos, r.value) for r in detect.pattern_findings(d, ["fmt_exclamation"]).collect()] == [(23, "!")]


def test_edge_rows_do_not_crash(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "utilize!"), (2, ""), (3, "utilize " * 5000)], DOCS)
    found = detect.all_findings(d)
    assert found.count() == 5002
    assert {r.score for r in score.score_documents(d.where("doc_id < 3"), found).collect()} == {100}
    for f in (stats.rhythm, stats.openers, stats.transitions, stats.passives, stats.semicolons, stats.similar_paragraphs, stats.headings, stats.stylometrics, integrity.integrity_findings, pairs.digests, pairs.repaired, corpus.convergent):
        f(d).collect()
        assert f(d.limit(0)).collect() == []


def test_tracking_only(spark):
    from pyspark.sql import functions as F

    urls = ["https://a/?utm_source=x&gclid=1", "https://a/?id=1&utm_source=x", "https://a/", "https://a/?UTM_Source=x#y", "https://a/?utm_source=x)."]
    rows = docs(spark, *urls).select(integrity.is_tracking(F.col("text"))).collect()
    assert [r[0] for r in rows] == [True, False, False, True, True]


def test_repairs_keep_the_rest(spark):
    import hashlib

    row = pairs.repaired(docs(spark, "We utilize it in order to win; `utilize` stays.")).first()
    assert row.edits == 2 and row.fixed_sha256 == hashlib.sha256(b"We use it to win; `utilize` stays.").hexdigest()


def test_convergence_by_brute_force(spark):
    base = ["red fox ran home today", "blue owl sat still here", "we learned much that day", "the end came slowly now"]
    texts = [". ".join(base[:i] + [f"other words stand {i} here {j}"] + base[i + 1 :]) + "." for i in range(4) for j in range(3)] + ["solo text without company."]
    d = docs(spark, *texts)
    shaped = {r.doc_id: [set(r[s]) for s in corpus.SLOTS] for r in corpus.shapes(d).collect()}
    reps = {}
    for i, s in shaped.items():
        reps.setdefault(tuple(map(frozenset, s)), i)
    alike = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.5
    want = {(a, b, n) for a in reps.values() for b in reps.values() if a < b and (n := sum(alike(x, y) for x, y in zip(shaped[a], shaped[b], strict=True))) >= 2}
    assert {tuple(r) for r in corpus.convergent(d).collect()} == want and want


def test_routing(spark):
    turns = spark.createDataFrame([(1, 0, "user", "scan my draft"), (1, 1, "user", "write a python script"), (1, 2, "user", "fix and clean a.md, rewrite"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert [r.mode for r in review.routed(turns).orderBy("conv_id", "turn").collect()] == ["detect", "none", "edit", "none"]


def test_many_matches_of_one_text(spark):
    """80,000 matches in one text of half a million characters: each with its place and value, in time that grows with the matches."""
    import time

    docs = spark.createDataFrame([(1, "hello! " * 80_000 + "é now!")], "doc_id long, text string")
    found = detect.pattern_findings(docs, ["fmt_exclamation"])
    found.limit(1).collect()
    began = time.time()
    told = found.selectExpr("count(*) AS n", "max(end_pos) AS last", "count_if(value = '!') AS right", "count_if(start_pos % 7 = 5) AS placed").collect()[0]
    assert tuple(told) == (80_001, 560_006, 80_001, 80_001) and time.time() - began < 30
