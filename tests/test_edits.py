"""Interval joins, chosen spans, moved blocks, carried offsets, mending and delivery against slow counterparts, and hand cases."""

import random
from bisect import bisect_left

import pytest

from inkspan.operators import calibration, reshape
from inkspan.plans import edits

SPANS = "doc_id long, start_pos long, end_pos long"


@pytest.mark.parametrize("width", [1, 7, 512])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(width)
    made = lambda n: [(rng.randrange(3), a, a + rng.randrange(0, 30)) for a in (rng.randrange(0, 120) for _ in range(n))]
    left, right = list(dict.fromkeys(made(80))), [*dict.fromkeys(made(80)), (None, 1, 5), (1, None, 5)]
    got = calibration.overlapping(spark.createDataFrame([*left, (None, 0, 9)], SPANS), spark.createDataFrame(right, SPANS), width=width)
    want = sorted((d, a, b, x, y) for d, a, b in left for e, x, y in right if d == e and x is not None and a < b and x < y and a < y and x < b)
    assert sorted(tuple(r[c] for c in ("doc_id", "start_pos", "end_pos", "right_start", "right_end")) for r in got.collect()) == want


def test_one_document_of_very_many_spans(spark):
    """50,000 spans of one document against as many: rows grow with the overlaps, not with the pairs."""
    spans = spark.range(50_000).selectExpr("1L AS doc_id", "id * 10 AS start_pos", "id * 10 + 12 AS end_pos")
    assert calibration.overlapping(spans, spans).count() == 50_000 + 2 * 49_999
    hits = calibration.clean_span_hits(spans, spans.selectExpr("doc_id", "'r' AS rule_id", "start_pos", "end_pos").where("start_pos > 100"))
    assert hits.where("hit").count() == 50_000 - 10
    chosen = reshape.smallest_first(spans)
    assert chosen.count() == 25_000


def test_expected_and_absent(spark):
    found = spark.createDataFrame([(1, "a", "x", 0, 4, True), (1, "a", "x", 9, 12, False), (2, "b", "y", 0, 2, False)], "doc_id long, rule_id string, category string, start_pos long, end_pos long, is_primary boolean")
    labels = spark.createDataFrame([(1, "a", "x", 9, 12), (1, "a", "z", 9, 13), (1, "b", "y", 0, 1), (2, "b", "y", 0, 2), (None, "a", "x", 0, 4)], "doc_id long, rule_id string, category string, start_pos long, end_pos long")
    told = {(r.doc_id, r.rule_id, r.end_pos): (r.found, r.exact, r.category_match) for r in calibration.expected_findings(labels, found).collect()}
    assert told == {(1, "a", 12): (True, True, True), (1, "a", 13): (True, False, False), (1, "b", 1): (False, False, True), (2, "b", 2): (True, True, True), (None, "a", 4): (False, False, True)}
    assert sorted((r.doc_id, r.rule_id, r.present) for r in calibration.absent_findings(labels.where("doc_id > 0"), found).distinct().collect()) == [(1, "a", True), (1, "b", False), (2, "b", False)]
    clean = spark.createDataFrame([(1, 4, 9), (1, 3, 5), (3, 0, 9)], SPANS)
    hits = calibration.clean_span_hits(clean, found)
    assert sorted(map(tuple, hits.collect())) == [(1, 3, 5, 1, "a", True), (1, 4, 9, 0, "", False), (3, 0, 9, 0, "", False)]
    rates = calibration.detection_rates(calibration.expected_findings(labels, found).selectExpr("'g' AS g", "found", "exact"), hits.selectExpr("if(doc_id = 1, 'g', 'h') AS g", "hit"), "g")
    assert {r.g: (r.recall, r.exact_rate, r.false_positive_rate) for r in rates.collect()} == {"g": (0.6, 0.4, 0.5), "h": (None, None, 0.0)}


def slow_smallest(spans):
    kept = []
    for a, b in sorted(spans, key=lambda s: (s[1] - s[0], s[0])):
        if not any(a < y and x < b for x, y in kept):
            kept.append((a, b))
    return sorted(kept)


def test_smallest_spans_equal_a_slow_choice(spark):
    rng = random.Random(6)
    rows = [(d, a, a + rng.randrange(1, 25)) for d in range(20) for a in (rng.randrange(0, 200) for _ in range(rng.randrange(0, 40)))]
    got = {}
    for r in reshape.smallest_first(spark.createDataFrame(rows, SPANS)).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    assert {d: sorted(v) for d, v in got.items()} == {d: slow_smallest([(a, b) for e, a, b in rows if e == d]) for d in {r[0] for r in rows}}


def test_smallest_spans_of_many_documents_go_to_the_helper_at_once(spark, sf_dir):
    """No call of Python for each document, columns and keys as they are, and findings whose places alone are asked for are not weighed."""
    rows = [("x", 0, 9, None), ("x", 4, 6, "kept"), (None, 1, 2, "of no one"), ("y", None, 3, "unplaced"), ("y", 0, 5, "late"), ("y", 0, 4, "early")]
    frame = reshape.smallest_first(spark.createDataFrame(rows, "name string, start_pos long, end_pos long, note string"), "name")
    assert frame.columns == ["name", "start_pos", "end_pos", "note"]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted([rows[1], rows[2], rows[3], rows[5]], key=repr)
    assert "InPandas" not in frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in edits.OPERATORS["smallest_spans"][0](spark, sf_dir)._jdf.queryExecution().analyzed().toString()


def test_moved_blocks_are_what_a_longest_run_leaves():
    rng = random.Random(7)
    for _ in range(500):
        places = rng.sample(range(30), rng.randrange(0, 12))
        tops = []
        for p in places:
            tops[bisect_left(tops, p) : bisect_left(tops, p) + 1] = [p]
        moved = reshape.least_moved(places)
        assert len(moved) == len(places) - len(tops)
        kept = [p for i, p in enumerate(places) if i not in moved]
        assert kept == sorted(kept)
    assert reshape.least_moved(list(range(50_000)) + [-1]) == [50_000]


def test_block_shapes(spark):
    cases = [("a\nb\nc", "a\nb\nc", (3, 3, 0, 0, 0, False, True)), ("a\nb\nc", "c\na\nb", (3, 3, 0, 0, 1, True, False)), ("a\na\nb", "a\nb\na", (3, 3, 0, 0, 1, True, False)), ("a\n\n b  c \n", "b c\nd", (2, 2, 1, 1, 0, False, False)), (None, "x", (0, 1, 0, 1, 0, False, False)), (None, None, (0, 0, 0, 0, 0, False, True)), ("d\nc\nb\na", "a\nb\nc\nd", (4, 4, 0, 0, 3, True, False))]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)] + [(0, "p", "q")], "pair_id long, source string, candidate string")
    got = sorted(map(tuple, reshape.block_shape(pairs).collect()))
    assert got == sorted([(i, *told) for i, (*_, told) in enumerate(cases)] + [(0, 1, 1, 1, 1, 0, False, False)])


def test_offsets_follow_edits(spark):
    text, cuts = "We delve in order to utilize it all.", [(3, 8, "dig"), (12, 20, "to"), (21, 28, "use")]
    fixed, done = "", 0
    for a, b, new in cuts:
        fixed, done = fixed + text[done:a] + new, b
    fixed += text[done:]
    places = spark.createDataFrame([(1, p, f"n{p}") for p in (0, 2, 8, 9, 20, 29, 32, 36)] + [(2, 5, "x")], "doc_id long, pos long, note string")
    made = spark.createDataFrame([(1, a, b, len(new) - b + a) for a, b, new in cuts], "doc_id long, start_pos long, end_pos long, longer_by long")
    got = {(r.doc_id, r.pos): r.candidate_pos for r in reshape.carried(places, made).collect()}
    assert got.pop((2, 5)) == 5 and got[1, 36] == len(fixed)
    assert all(text[p : p + 3] == fixed[q : q + 3] for (_, p), q in got.items() if p in (9, 29, 32))


def test_mending(spark):
    long = "The deployment pipeline handles releases regularly and we are in no hurry about it. "
    rows = [(1, long + "We utilize a plan."), (2, "Utilize."), (3, long), (4, None), (1, long + "They utilize `utilize` and \"utilize\".")]
    told = sorted(((r.doc_id, r.rounds, r.edits, r.decision, r.text) for r in reshape.mended(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert told == sorted([(1, 1, 1, "accept", long + "We use a plan."), (1, 1, 1, "accept", long + "They use `utilize` and \"utilize\"."), (2, 1, 0, "reject", "Utilize."), (3, 0, 0, "unchanged", long), (4, 0, 0, "unchanged", None)], key=repr)
    again = reshape.mended(spark.createDataFrame([(r[0], r[4]) for r in told if r[3] == "accept"], "doc_id long, text string"))
    assert {r.decision for r in again.collect()} == {"unchanged"}


def test_delivery_states(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, chunk int, text string")
    was = table((1, 0, "a\nb"), (1, 1, "c"), (2, 0, "a"), (2, 1, "b"), (3, 0, "x"), (3, 1, None))
    now = table((1, 0, "a\r\nb"), (1, 1, "c"), (2, 0, "b"), (2, 1, "a"), (3, 0, "y"), (3, 2, "z"), (4, 0, "new"))
    got = {r.doc_id: (r.chunks, r.kept, r.stale, r.swapped, r.missing, r.extra, r.decision, r.recorded_digest == r.delivered_digest) for r in reshape.delivery(was, now).collect()}
    assert got == {1: (2, 2, 0, 0, 0, 0, "verified", True), 2: (2, 0, 0, 2, 0, 0, "failed", False), 3: (2, 0, 1, 0, 1, 1, "failed", False), 4: (0, 0, 0, 0, 0, 1, "failed", False)}


@pytest.mark.parametrize("name", [n for n, (_, sql) in edits.OPERATORS.items() if not sql])
def test_queries_without_sql_find_something(spark, sf_dir, name):
    rows = edits.OPERATORS[name][0](spark, sf_dir).collect()
    assert rows
    if "decision" in rows[0]:
        assert len({r.decision for r in rows}) > 1
