"""Convergence of documents by brute force: copies of a shape, edited middles, hot openings."""

from itertools import combinations

from inkspan.operators import corpus

DOCS = "doc_id long, text string"


def alike(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= corpus.LEAST


def shaped(d):
    return {r.doc_id: [set(r[s]) for s in corpus.SLOTS] for r in corpus.shapes(d).collect()}


def test_members_and_pairs_tell_every_pair_of_documents(spark):
    """Texts that differ in their middles alone have one shape, and a pair of representatives stands for all of its copies."""
    frame = "The red fox ran home.\n\nThe blue owl sat {}.\n\nMiddle {} stands here. We learned a great deal.\n\nThen all of it was over."
    texts = [frame.format("still", i) for i in range(3)] + [frame.format("still there", i) for i in range(2)] + ["!!!\n\n!!!", "!!!\n\n???", "One more text without company."]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS)
    sets = shaped(d)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sum(alike(x, y) for x, y in zip(sets[a], sets[b], strict=True)) >= corpus.MIN_SLOTS}
    rows = corpus.members(d).collect()
    assert {r.doc_id for r in rows} == set(sets)
    linked = {(r.doc_a, r.doc_b) for r in corpus.convergent(d).collect()}
    got = {(a.doc_id, b.doc_id) for a in rows for b in rows if a.doc_id < b.doc_id and (a.convergent if a.rep == b.rep else (min(a.rep, b.rep), max(a.rep, b.rep)) in linked)}
    assert got == want and {(0, 1), (3, 4), (1, 4)} <= want
    assert {r.doc_id: r.documents for r in rows}[1] == 3


def _rows(n):
    """Documents of one opening, and of closings in families of three; the rest of each differs."""
    return [(i, f"The same opening stands here always.\n\nUnlike{i} reveal{i}.\n\nMiddle{i} part{i}.\n\nClosing{i // 3} word{i // 3} of{i // 3} end{i % 7}.") for i in range(n)]


def test_tiles_give_what_brute_force_gives(spark):
    d = spark.createDataFrame(_rows(60), DOCS)
    sets = shaped(d)
    want = {(a, b, n) for a, b in combinations(sorted(sets), 2) if (n := sum(alike(x, y) for x, y in zip(sets[a], sets[b], strict=True))) >= corpus.MIN_SLOTS}
    for size in (4, corpus.TILE):
        assert {tuple(r) for r in corpus.convergent(d, size).collect()} == want and want


def test_shapes_alike_in_one_slot_are_never_paired(spark):
    """A hot opening: all pairs of it would be half a million rows; the largest step holds a few for each document."""
    d = spark.createDataFrame(_rows(1000), DOCS)
    frame = corpus.convergent(d)
    assert frame.count() > 0
    done = frame._jdf.queryExecution()
    frame.collect()
    nodes, largest = [done.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        for at in ("finalPhysicalPlan", "plan"):
            if node.getClass().getSimpleName() in {"finalPhysicalPlan": ("AdaptiveSparkPlanExec",), "plan": ("ShuffleQueryStageExec", "BroadcastQueryStageExec")}[at]:
                nodes.append(getattr(node, at)())
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            largest = max(largest, metrics.apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < largest < 100_000


def test_sets_that_share_few_words_are_never_written(spark):
    """Sets of twelve words that share one or five each: they meet under a word, but the join tells that they cannot be alike."""
    sets = [(i, "hook", [f"shared{i % 2}", *[f"half{i % 5}{k}" for k in range(4)], *[f"own{i}x{k}" for k in range(7)]]) for i in range(40)] + [(99, "hook", ["shared0", *[f"half0{k}" for k in range(4)], *[f"own0x{k}" for k in range(7)], "more"])]
    frame = corpus.alike_sets(spark.createDataFrame(sets, "set_id long, slot string, words array<string>"))
    want = {(a, b) for a, _, x in sets for b, _, y in sets if alike(set(x), set(y))}
    assert {(r.a, r.b) for r in frame.collect()} == want and (0, 99) in want
    assert "array_intersect(ha" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_never_shuffled(spark):
    """One family of 300 shapes has 44,850 pairs in three slots; what is written grows with the shapes, not with the pairs."""
    d = spark.createDataFrame([(i, f"Unlike{i} opening{i} number{i}.\n\nThe same reveal stands here.\n\nWe learned the same lesson always.\n\nAll of it closes alike.") for i in range(300)], DOCS)
    frame = corpus.convergent(d)
    done = frame._jdf.queryExecution()
    done.toRdd().count()
    nodes, largest = [done.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        for at in ("finalPhysicalPlan", "plan"):
            if node.getClass().getSimpleName() in {"finalPhysicalPlan": ("AdaptiveSparkPlanExec",), "plan": ("ShuffleQueryStageExec", "BroadcastQueryStageExec")}[at]:
                nodes.append(getattr(node, at)())
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            largest = max(largest, metrics.apply("shuffleRecordsWritten").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < largest < 5_000
    assert {(r.slots, r["count"]) for r in frame.groupBy("slots").count().collect()} == {(3, 44_850)}


def test_a_set_that_many_are_like_is_not_widened(spark):
    """Closings that are all like one, with lessons of their own, and empty slots: as brute force tells, in tiles too."""
    rows = [(i, f"Unlike{i} opening{i}.\n\nReveal{i} part{i}.\n\nWe learned thing{i // 2} here{i // 2} and there{i // 2}.\n\nAll of it closes alike now{'' if i % 3 else f' extra{i}'}.") for i in range(24)]
    d = spark.createDataFrame([*rows, (30, "!!!\n\n!!!"), (31, "Unlike1 opening1.\n\n!!!\n\n???"), (32, "Unlike1 opening1 too.\n\nReveal1 part1.")], DOCS)
    sets = shaped(d)
    want = {(a, b, n) for a, b in combinations(sorted(sets), 2) if (n := sum(alike(x, y) for x, y in zip(sets[a], sets[b], strict=True))) >= corpus.MIN_SLOTS}
    for size in (3, corpus.TILE):
        got = [tuple(r) for r in corpus.convergent(d, size).collect()]
        assert sorted(got) == sorted(want) and want
