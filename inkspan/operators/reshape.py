"""Edits that move, mend or deliver texts: block shape, smallest spans first, offsets carried over edits, mending in rounds, chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.workers import importable
from . import fidelity, pairs
from .fidelity import helper

#: Rounds of mending; what the gate turns back keeps its source.
ROUNDS = 2


def blocks(text: Column) -> Column:
    """Runs of lines between line ends, white space collapsed, those without any text left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+", -1), lambda b: F.btrim(F.regexp_replace(b, r"\s+", " ")))
    return F.filter(parts, lambda b: b != "")


def least_moved(places: list[int]) -> list[int]:
    """Which of some places stand outside a longest rising run of them; of several such runs, the one that patience keeps."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        k = bisect_left(tops, place)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(place)
            piles.append(i)
        else:
            tops[k], piles[k] = place, i
    kept, at = set(), piles[-1] if piles else -1
    while at >= 0:
        kept.add(at)
        at = before[at]
    return [i for i in range(len(places)) if i not in kept]


@helper(ArrayType(IntegerType()))
def _moved(places: pd.Series) -> pd.Series:
    return pd.Series([[p[i] for i in least_moved(list(p))] for p in places])


def block_shape(pairs: DataFrame) -> DataFrame:
    """How the blocks of each pair (pair_id, source, candidate) changed: removed, added, moved, and whether only their order did.

    The n-th occurrence of a block in the source is that of the candidate; both are rows that meet by a hash of the block. What
    stands outside a longest run of matched blocks in rising order has moved. Null sides are empty; rows of one id are apart.
    """
    importable(pairs.sparkSession)
    rows = pairs.select("pair_id", blocks(F.col("source")).alias("s"), blocks(F.col("candidate")).alias("c"), F.monotonically_increasing_id().alias("row"))
    of = lambda side: F.transform(F.col(side), lambda b, i: F.struct(F.lit(side).alias("side"), F.md5(b.cast("binary")).alias("block"), i.alias("at")))
    told = rows.select("row", "pair_id", F.explode_outer(F.concat(of("s"), of("c"))).alias("b")).select("row", "pair_id", "b.*")
    nth = told.withColumn("nth", F.row_number().over(Window.partitionBy("row", "block", "side").orderBy("at")))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("at")))
    met = nth.groupBy("row", "pair_id", "block", "nth").agg(at("s").alias("s"), at("c").alias("c"))
    matched = F.transform(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull() & F.col("c").isNotNull(), F.struct("s", "c")))), lambda m: m["c"])
    counted = met.groupBy("row", "pair_id").agg(F.count("s").alias("source_blocks"), F.count("c").alias("candidate_blocks"), F.sum((F.col("s").isNotNull() & F.col("c").isNull()).cast("long")).alias("removed"), F.sum((F.col("s").isNull() & F.col("c").isNotNull()).cast("long")).alias("added"), matched.alias("places"))
    out = counted.withColumn("moved", F.size(_moved("places")).cast("long"))
    same = (F.col("removed") == 0) & (F.col("added") == 0)
    return out.select("pair_id", "source_blocks", "candidate_blocks", "removed", "added", "moved", (same & (F.col("moved") > 0)).alias("reordered"), (same & (F.col("moved") == 0)).alias("unchanged"))


@helper(ArrayType(IntegerType()))
def _smallest(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Numbers of the spans that are chosen, shortest first, then the first; a span without both places overlaps nothing."""
    out = []
    for a, b in zip(starts, ends, strict=True):
        kept, tops, tails = [], [], []
        for i in sorted(range(len(a)), key=lambda i: (False, b[i] - a[i], a[i]) if a[i] is not None and b[i] is not None else (True, 0, 0)):
            start, end = a[i], b[i]
            if start is not None and end is not None:
                at = bisect_right(tops, start)
                if (at and tails[at - 1] > start) or (at < len(tops) and tops[at] < end):
                    continue
                tops.insert(at, start)
                tails.insert(at, end)
            kept.append(i)
        out.append(sorted(kept))
    return pd.Series(out)


def smallest_first(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spans`` (key, start_pos, end_pos, and more) that are chosen: the shortest first, then the first, none that overlaps one chosen.

    Chosen spans are kept in order, so a document of n spans takes n log n steps. A document's spans are one row, and very many
    rows go to the helper at once.
    """
    importable(spans.sparkSession)
    held = spans.groupBy(key).agg(F.collect_list(F.struct(*[c for c in spans.columns if c != key])).alias("held"))
    told = held.withColumn("chosen", _smallest(F.transform("held", lambda s: s["start_pos"]), F.transform("held", lambda s: s["end_pos"])))
    return told.select(key, F.explode(F.transform("chosen", lambda i: F.get("held", i))).alias("s")).select(*[F.col(c if c == key else f"s.{c}").alias(c) for c in spans.columns])


def carried(places: DataFrame, edits: DataFrame) -> DataFrame:
    """``places`` (doc_id, pos, and more) with candidate_pos: where a place of the source stands after ``edits`` (doc_id, start_pos,
    end_pos, longer_by: characters gained), that is moved by all edits that end at it or before it.

    Places and edits go through one running sum by place; nothing is joined, so many edits of a document make no pairs.
    """
    more = [c for c in places.columns if c not in ("doc_id", "pos")]
    as_place = places.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("longer_by"), *more)
    as_edit = edits.select("doc_id", F.col("end_pos").alias("pos"), F.lit(0).alias("kind"), F.col("longer_by").cast("long").alias("longer_by"), *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in more])
    running = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    told = as_place.unionByName(as_edit).withColumn("candidate_pos", F.col("pos") + F.sum("longer_by").over(running))
    return told.where("kind = 1").drop("kind", "longer_by")


def mended(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, rounds, edits, decision, text) after corrections in rounds, each judged by the fidelity gate against its own text.

    A round plans and makes the corrections of the texts that may still change; what the gate rejects or leaves to review is put
    back and takes no further part. Each round is written, so a lost executor costs one. decision: unchanged, accept, or the gate's
    word for what was put back. Rows of one id are told apart; a null text has nothing to mend.
    """
    state = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("edits"), F.lit("unchanged").alias("decision"), F.lit(True).alias("open"))
    state = written(state)
    for _ in range(rounds):
        edits, fixed = pairs.repaired_text(F.col("text"))
        tried = written(state.where("open and text is not null").select("*", edits.alias("made"), fixed.alias("fixed")).where("made > 0"))
        if tried.isEmpty():
            break
        judged = fidelity.gate(tried.select(F.col("row").alias("pair_id"), F.col("text").alias("source"), F.col("fixed").alias("candidate"))).select(F.col("pair_id").alias("row"), F.col("decision").alias("told"))
        turn = tried.select("row", "made", "fixed").join(judged, "row")
        met = state.join(turn, "row", "left")
        good, took = F.col("told") == "accept", F.col("told").isNotNull()
        state = written(met.select("doc_id", F.when(good, F.col("fixed")).otherwise(F.col("text")).alias("text"), "row", (F.col("rounds") + took.cast("int")).alias("rounds"), (F.col("edits") + F.when(good, F.col("made")).otherwise(0)).alias("edits"), F.coalesce("told", "decision").alias("decision"), (took & F.coalesce(good, F.lit(False))).alias("open")))
    return state.select("doc_id", "rounds", "edits", "decision", "text")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` from the folder that the session names in spark.checkpoint.dir; where none is named, one in the warehouse."""
    session = rows.sparkSession
    if not session.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = session.conf.get("spark.checkpoint.dir", None) or f"{session.conf.get('spark.sql.warehouse.dir').rstrip('/')}/inkspan-scratch"
        session.sparkContext.setCheckpointDir(folder)
    return rows.checkpoint()


def delivery(recorded: DataFrame, delivered: DataFrame) -> DataFrame:
    """How the chunks of each document were delivered: (doc_id, chunks, kept, stale, swapped, missing, extra, recorded_digest, delivered_digest, decision).

    Both tables hold (doc_id, chunk, text). A chunk is kept if its digest is the recorded one, swapped if it is that of another
    recorded chunk of the document, else stale; recorded chunks that did not come are missing, unrecorded ones extra. Digests are
    sha256 of bodies with LF line ends; those of a document are of its chunks' digests in order. Texts stay where they are; digests meet.
    """
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n"), 256)
    was, now = (t.select("doc_id", "chunk", digest.alias(name)) for t, name in ((recorded, "was"), (delivered, "now")))
    known = was.select("doc_id", F.col("was").alias("now")).distinct().withColumn("known", F.lit(True))
    met = was.join(now, ["doc_id", "chunk"], "full").join(known, ["doc_id", "now"], "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") == F.col("now"), "kept").when(F.col("known"), "swapped").otherwise("stale")
    rolled = lambda name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("chunk", name)))), lambda c: c[name]), "\n"), 256)
    states = ("kept", "stale", "swapped", "missing", "extra")
    told = met.withColumn("state", state).groupBy("doc_id").agg(F.count("was").alias("chunks"), *[F.sum((F.col("state") == s).cast("long")).alias(s) for s in states], rolled("was").alias("recorded_digest"), rolled("now").alias("delivered_digest"))
    return told.withColumn("decision", F.when((F.col("kept") == F.col("chunks")) & (F.col("extra") == 0), "verified").otherwise("failed"))
