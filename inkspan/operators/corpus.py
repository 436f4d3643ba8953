"""Cross-document convergence: documents that share the shape of their hook, reveal, lesson and close."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reshape import written

SLOTS = ("hook", "reveal", "lesson", "close")
MIN_SLOTS, LEAST = 2, 0.5
#: Rows of one key that meet in one group, about. A row is sent once for each tile of its key, so small tiles cost much disk.
TILE = 4096
# Words that mark a lesson
LESSON = r"(?i)learned|lesson|taught|takeaway|the moral"


def _words(sentence: Column) -> Column:
    return F.array_sort(T.word_set(F.coalesce(sentence, F.lit(""))))


def shapes(docs: DataFrame) -> DataFrame:
    """(doc_id, hook, reveal, lesson, close): sorted word sets of the first sentence, the first of the second paragraph, the
    first that marks a lesson (else the first of the last paragraph), and the last."""
    made = docs.select("doc_id", T.paragraphs(T.mask_code(T.folded(F.col("text")))).alias("p")).where("size(p) > 0")
    made = made.withColumns({"first": T.sentences(F.col("p")[0]), "second": T.sentences(F.coalesce(F.get("p", F.lit(1)), F.lit(""))), "last": T.sentences(F.element_at("p", -1)), "all": F.flatten(F.transform("p", T.sentences))})
    hook = _words(F.get("first", F.lit(0)))
    lesson = F.get(F.filter("all", lambda s: F.regexp_like(s, F.lit(LESSON))), F.lit(0))
    return made.select("doc_id", hook.alias("hook"), F.when(F.size("p") >= 2, _words(F.get("second", F.lit(0)))).otherwise(hook).alias("reveal"), _words(F.coalesce(lesson, F.get("last", F.lit(0)))).alias("lesson"), _words(F.try_element_at("last", F.lit(-1))).alias("close"))


def classes(shaped: DataFrame) -> DataFrame:
    """Distinct shapes with the least doc_id of each and the number of documents: copies are one row of each task."""
    return shaped.groupBy(*SLOTS).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("documents"))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, documents, convergent): the class of each document, its size, and whether its own documents converge.

    Documents of equal shape agree in all slots, so a class of several converges if two slots or more have words. With the
    pairs of ``convergent``, which are between representatives, this tells each pair of documents.
    """
    shaped = shapes(docs)
    filled = sum((F.size(s) > 0).cast("int") for s in SLOTS)
    return shaped.join(classes(shaped), list(SLOTS)).select("doc_id", "rep", "documents", ((F.col("documents") > 1) & (filled >= MIN_SLOTS)).alias("convergent"))


def pairs_of_sets(sets: DataFrame, size: int = TILE) -> DataFrame:
    """(slot, a, b): ids of different word sets (set_id, slot, words) of a slot with a Jaccard of 0.5 or more, each pair once.

    Two sets can only be that alike if they share one of their rarest words, of n words the n - ceil(n/2) + 1 rarest, and if
    one has at most twice the words of the other. The join is on those words; words that one set alone holds pair nothing. The
    sets of a common word meet tile by tile, a pair in one square of tiles. What two sets can share at most is told inside the
    join, by the word's places in their orders and by short hashes of what comes after it, which travel along: pairs that cannot
    be alike are never written, and words are compared for the rest.
    """
    words = sets.select("set_id", "slot", F.size("words").alias("n"), F.explode("words").alias("word"))
    frequency = words.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("f"))
    ordered = words.join(frequency, ["slot", "word"]).groupBy("set_id", "slot", "n").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("w"))
    told = ordered.withColumn("hashes", F.transform("w", lambda x: F.hash(x["word"]))).withColumn("twins", F.col("n") - F.size(F.array_distinct("hashes")))
    prefix = told.select("slot", "set_id", "n", "twins", "hashes", F.posexplode(F.slice("w", F.lit(1), F.col("n") - F.ceil(F.col("n") / 2).cast("int") + 1)).alias("at", "p")).where("p.f > 1")
    tiles = F.ceil(F.col("p.f") / size).cast("int")
    dealt = prefix.select("slot", F.col("p.word").alias("word"), "set_id", "n", "twins", "at", F.slice("hashes", F.col("at") + 1, F.col("n")).alias("rest"), F.pmod(F.xxhash64(F.lit("tile"), "set_id"), tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("with"))
    side = lambda x: dealt.select("slot", "word", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("twins").alias(f"twins{x}"), F.col("at").alias(f"at{x}"), F.col("rest").alias(f"h{x}"), F.col("tile").alias(f"tile{x}"))
    # Alike sets share a third of both their words or more; at the first word that they share, all others come after it
    first = "a < b and (i = j or tilea <> tileb) and na <= 2 * nb and nb <= 2 * na and 3 * (least(na - ata, nb - atb)) >= na + nb"
    met = side("a").join(side("b"), ["slot", "word", "i", "j"]).where(f"CASE WHEN {first} THEN 3 * (size(array_intersect(ha, hb)) + twinsa) >= na + nb ELSE false END").select("slot", "a", "b").distinct()
    left, right = (sets.select("slot", F.col("set_id").alias(x), F.col("words").alias(f"w{x}")) for x in ("a", "b"))
    return met.join(left, ["slot", "a"]).join(right, ["slot", "b"]).where(T.jaccard(F.col("wa"), F.col("wb")) >= LEAST).select("slot", "a", "b")


def _directed(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``pairs`` (slot, a, b) in both directions, and each of ``ids`` (slot, set_id) with itself."""
    both = pairs.select("slot", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("slot", "x.a", "x.b")
    return both.unionByName(ids.select("slot", F.col("set_id").alias("a"), F.col("set_id").alias("b")))


def alike_sets(sets: DataFrame, size: int = TILE) -> DataFrame:
    """``pairs_of_sets`` in both directions, and each set with itself."""
    return _directed(pairs_of_sets(sets, size), sets)


def _linked(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell, other) of different cells (s, t, x, y, cell, n) whose sets are alike in both slots, each pair once.

    A cell looks for others by the one of its two sets under whose like there are fewer cells; then the other set is judged. So
    neither a set that very many cells hold nor one that very many are like is widened where the other set tells more.
    """
    near = _directed(pairs.select(F.lit(0).alias("slot"), "a", "b"), cells.select(F.lit(0).alias("slot"), F.explode(F.array("x", "y")).alias("set_id")).distinct()).drop("slot")
    fans = {}
    for side in ("x", "y"):
        held = cells.groupBy("s", "t", F.col(side).alias("b")).agg(F.count(F.lit(1)).alias("cells"))
        fans[side] = near.join(held, "b").groupBy("s", "t", F.col("a").alias(side)).agg(F.sum("cells").alias(f"by_{side}"))
    # A cell that finds itself alone by one of its sets has no other
    known = cells.join(fans["x"], ["s", "t", "x"]).join(fans["y"], ["s", "t", "y"]).where("by_x > 1 and by_y > 1")
    found = []
    for side, judged, chosen in (("x", "y", "by_x <= by_y"), ("y", "x", "by_y < by_x")):
        own = known.where(chosen).join(near, F.col(side) == F.col("a")).select("s", "t", F.col("b").alias(side), F.col(judged).alias("own"), "cell", "kept")
        theirs = known.select("s", "t", side, F.col(judged).alias("theirs"), F.col("cell").alias("other"), F.col("kept").alias("other_kept"))
        found.append(own.join(theirs, ["s", "t", side]).where("cell < other").select("cell", "other", "kept", "other_kept", F.least("own", "theirs").alias("a"), F.greatest("own", "theirs").alias("b")))
    # Where all shapes of both cells share one set of a slot that comes first, their pairs are told under that slot
    met = found[0].unionByName(found[1]).where("NOT arrays_overlap(kept, other_kept)").drop("kept", "other_kept")
    return met.join(pairs.select("a", "b", F.lit(True).alias("alike")), ["a", "b"], "left").where("a = b or alike").select("cell", "other")


def convergent(docs: DataFrame, size: int = TILE) -> DataFrame:
    """Pairs of distinct shapes, by their representatives, of which two slots or more have a Jaccard of 0.5 or more.

    Distinct word sets are paired once, whatever slots hold them. Shapes meet by two slots at once, in cells: a shape is held
    under the pair of its set ids, for each two slots, and meets the shapes of its own cell and of cells whose sets are alike, so
    shapes that agree in one slot only are never paired. Shapes of one cell meet tile by tile. The words of the other two slots
    travel along: a pair is judged whole where it meets, and told under the first two slots that agree. So pairs are never
    shuffled, and what is written grows with the shapes. Slots that are empty on both sides score 0. The pairs themselves grow
    with the square of the shapes that agree. Documents of equal shape are one class; ``members`` tells which, and whether they
    converge among themselves.
    """
    hashed = lambda s: F.when(F.size(s) > 0, F.transform(s, lambda w: F.xxhash64(w)))
    ids, words = ([f"{kind}{n}" for n in range(len(SLOTS))] for kind in ("id", "words"))
    shaped = classes(shapes(docs)).select("rep", *[hashed(s).alias(w) for s, w in zip(SLOTS, words, strict=True)])
    shaped = shaped.select("*", *[F.when(F.col(w).isNotNull(), F.xxhash64(w)).alias(i) for i, w in zip(ids, words, strict=True)])
    shaped = written(shaped.withColumn("shape", F.xxhash64(*[F.coalesce(i, F.lit(0)) for i in ids])))
    each = F.array(*[F.struct(F.lit(0).alias("slot"), F.col(i).alias("set_id"), F.col(w).alias("words")) for i, w in zip(ids, words, strict=True)])
    sets = shaped.select(F.explode(each).alias("y")).where("y.set_id is not null").select("y.*").dropDuplicates(["slot", "set_id"])
    pairs = written(pairs_of_sets(sets, size).select("a", "b"))

    def two(s: int, t: int) -> Column:
        u, v = (n for n in range(len(SLOTS)) if n not in (s, t))
        # Pairs that agree in a slot before t, other than s, are told under that slot
        before = {name: F.when(F.lit(n < t), F.col(ids[n])).alias(name) for name, n in (("p", u), ("q", v))}
        return F.struct(*[F.lit(n).alias(name) for name, n in (("s", s), ("t", t), ("u", u), ("v", v))], F.col(ids[s]).alias("x"), F.col(ids[t]).alias("y"), *before.values())

    held = shaped.select("shape", F.explode(F.array(*[two(s, t) for s, t in combinations(range(len(SLOTS)), 2)])).alias("two")).select("shape", "two.*")
    held = held.where("x is not null and y is not null").withColumn("cell", F.xxhash64("s", "t", "x", "y"))
    # A set that all shapes of a cell have in such a slot, named with the slot
    kept = lambda n, c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.xxhash64(F.lit(n), F.min(c)))
    cells = held.groupBy("s", "t", "x", "y", "cell").agg(F.count(F.lit(1)).alias("n"), F.array_compact(F.array(kept(0, "p"), kept(1, "q"))).alias("kept"))
    within = cells.where("n > 1 and size(kept) = 0").select("cell", F.col("cell").alias("other"))
    linked = written(within.unionByName(_linked(cells, pairs)))
    tiles = cells.select("cell", F.ceil(F.col("n") / size).cast("int").alias("tiles"))
    active = linked.select("cell").unionByName(linked.select(F.col("other").alias("cell"))).distinct().join(tiles, "cell")
    squares = linked.join(tiles, "cell").join(tiles.select(F.col("cell").alias("other"), F.col("tiles").alias("other_tiles")), "other")
    squares = squares.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    squares = squares.select("cell", "other", "i", F.explode(F.sequence(F.when(F.col("cell") == F.col("other"), F.col("i")).otherwise(0), F.col("other_tiles") - 1)).alias("j"))
    of = lambda n: F.get(F.array(*words), F.col(n))
    rows = held.join(active, "cell").select("shape", "cell", "t", "u", "v", F.pmod(F.xxhash64(F.lit("tile"), "shape"), F.col("tiles")).cast("int").alias("tile"))
    rows = rows.join(shaped.select("shape", "rep", *words), "shape").select("cell", "tile", "shape", "rep", "t", "u", "v", of("u").alias("wu"), of("v").alias("wv"))
    ours = rows.select("cell", F.col("tile").alias("i"), F.col("shape").alias("a"), F.col("rep").alias("one"), (F.col("u") < F.col("t")).alias("u_before"), (F.col("v") < F.col("t")).alias("v_before"), F.col("wu").alias("ua"), F.col("wv").alias("va"))
    theirs = rows.select(F.col("cell").alias("other"), F.col("tile").alias("j"), F.col("shape").alias("b"), F.col("rep").alias("another"), F.col("wu").alias("ub"), F.col("wv").alias("vb"))
    agree = {n: f"coalesce({n}a = {n}b OR size({n}a) <= 2 * size({n}b) AND size({n}b) <= 2 * size({n}a) AND 3 * size(array_intersect({n}a, {n}b)) >= size({n}a) + size({n}b), false)" for n in "uv"}
    once = "one <> another AND (cell <> other OR i <> j OR a < b)"
    met = squares.join(ours, ["cell", "i"]).join(theirs, ["other", "j"]).where(f"CASE WHEN {once} THEN NOT (u_before AND {agree['u']}) AND NOT (v_before AND {agree['v']}) ELSE false END")
    more = " + ".join(f"CASE WHEN {n}_before THEN 0 WHEN {held} THEN 1 ELSE 0 END" for n, held in agree.items())
    return met.select(F.least("one", "another").alias("doc_a"), F.greatest("one", "another").alias("doc_b"), F.expr(f"CAST(2 + {more} AS BIGINT)").alias("slots"))
