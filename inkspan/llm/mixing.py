"""Mixing sources to target weights by a curriculum that changes over the training time.

Each source has a weight and a schedule: a piecewise linear density of demand over the training time from 0 to 1, whose whole
integral stands for the source's target. A source's documents form a stream in an order drawn from their digests, repeated
until the target is met. A document that takes the words from x to y of its source's stream is wanted when the cumulative
demand reaches their middle: the inverse of the integrated schedule there is the document's training position. Documents are
range-sorted by position. All of it is DataFrame functions.

Prefix sums over a source are made in two steps: sums of parts of the order, whose number follows the source's documents,
then sums within each part, so that a source with a third of all rows is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: A document's words stand in the mix this many times at most.
MOST_TIMES = 3
#: Weights of sources, in the order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: Densities of demand as (time, height) knots from time 0 to 1, by a source's turn in WEIGHTS: heavier sources come later.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.8), (0.5, 1.2), (1.0, 0.8)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents of one part of a source's order.
PART = 1 << 11
#: Parts that the one row of a source is given to, so that a large source meets it in many tasks.
SALTS = 32


def pieces_of(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(demand before, demand after, start, height, slope) of each piece of a density, scaled to a whole demand of 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(h < 0 for _, h in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule is rising times from 0 to 1 with heights of 0 or more")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, []
    if total <= 0:
        raise ValueError("a schedule must have some demand")
    for (t, h), (u, k), area in zip(knots, knots[1:], areas, strict=False):
        out.append((done / total, (done + area) / total, t, h / total, (k - h) / (u - t) / total))
        done += area
    return out


def time_of(demand: Column, turn: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which the integrated schedule of a source reaches ``demand`` (0 to 1)."""
    out = F.lit(None).cast("double")
    for own, knots in enumerate(schedules):
        pieces = pieces_of(knots)
        told = F.lit(1.0)
        for low, high, start, height, slope in reversed(pieces):
            rest = F.greatest(demand - F.lit(low), F.lit(0.0))
            # The root of height x + slope x^2 / 2 = rest, in the form that holds for a slope of 0
            root = F.sqrt(F.greatest(F.lit(height * height) + F.lit(2 * slope) * rest, F.lit(0.0)))
            at = F.lit(start) + F.when(root + F.lit(height) > 0, 2 * rest / (root + F.lit(height))).otherwise(0.0)
            told = F.when(demand <= F.lit(high), at).otherwise(told)
        out = F.when(turn == own, F.least(told, F.lit(1.0))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """``sizes`` (source, source_size, documents) with number, turn, weight and target of each source.

    The sources share the sum of all sizes by weight; a target stops at ``most_times`` the source's size and the others share
    what it leaves. Filled in one pass: in rising order of limit over weight, a source is stopped where its limit is under its
    share of what those before it leave. Windows over all sources: a row each, no documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("number", F.row_number().over(by_name) - 1).withColumn("turn", F.pmod("number", F.lit(len(weights))))
    weighed = named.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("long"), "most": F.col("source_size") * most_times})
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = weighed.withColumns({"left": F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0)), "sharing": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    free = shared.withColumn("free", F.col("most") * F.col("sharing") >= F.col("left") * F.col("weight"))
    # The first free source's share holds for all that follow
    level = F.min(F.when(F.col("free"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", "left", "sharing"))).over(whole)
    told = free.withColumn("level", level)
    # A source after the first free one is free too, its limit over its weight being no less
    stopped = ~F.coalesce(F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source") >= F.struct("level.at", "level.last", "level.source"), F.lit(False))
    target = F.when(stopped, F.col("most").cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.sharing").cast("double"))
    return told.select("source", "source_size", "documents", "number", "turn", "weight", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): the words of each row and its place in the draw, a digest of its id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), draw.alias("draw"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, most_times: int = MOST_TIMES, part: int = PART) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by its first training position.

    doc_id, source, size (words), source_size, target and taken: the words that the mix takes, repeats counted. A source's
    stream is cut where the whole words of its target are taken, so that the takings of a source are its target, rounded
    down, and a document that the cut falls on is taken in part the last time. ``copies`` has (time, words, position) of each
    taking, the first words of the document each. ``position`` is the first copy's, null for what is not taken.

    Null and empty texts have size 0 and are not taken; a null source is a source, the last; null and repeated ids are rows
    like others, and rows equal in id and text share their source's takings in any order, with equal results. Long texts are
    counted whole. Other columns are ignored. No documents give no rows.
    """
    if len(weights) != len(schedules):
        raise ValueError("a schedule for each weight")
    rows = cut(sized(docs))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")), weights, most_times)
    sources = cut(sources.withColumn("parts", F.ceil(F.col("documents") / part).cast("int")))
    # 32 bits of the draw deal a source's documents over its parts, in the order of the draw
    share = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("salt", F.pmod(F.hash("draw"), F.lit(SALTS)))
    told = [F.col("source").alias("source_r"), "source_size", "number", "turn", "target", "parts"]
    salted = sources.select(*told, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_r"))
    own = dealt.join(salted, F.col("source").eqNullSafe(F.col("source_r")) & (F.col("salt") == F.col("salt_r"))).drop("source_r", "salt_r", "salt")
    placed = own.withColumn("part", F.floor(share * F.col("parts") / F.lit(1 << 32)).cast("int"))
    sums = placed.groupBy("number", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("number", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("number", "part").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = at.join(before, ["number", "part"]).withColumn("at", F.col("before") + F.col("within"))
    wanted = F.floor("target").cast("long")
    told = F.transform(F.sequence(F.lit(0), F.lit(most_times)), lambda t: F.struct((t + 1).alias("time"), (t * F.col("source_size") + F.col("at")).alias("start"), F.greatest(F.lit(0), F.least(F.col("size"), wanted - t * F.col("source_size") - F.col("at"))).alias("words")))
    taken = at.withColumn("takings", F.filter(told, lambda c: c["words"] > 0))
    copies = F.transform("takings", lambda c: F.struct(c["time"].alias("time"), c["words"].alias("words"), time_of((c["start"] + c["words"] / 2) / wanted, F.col("turn"), schedules).alias("position")))
    out = taken.select("doc_id", "source", "draw", "size", "source_size", "target", F.coalesce(F.aggregate("takings", F.lit(0).cast("long"), lambda a, c: a + c["words"]), F.lit(0)).alias("taken"), copies.alias("copies"))
    # The draw parts rows of one position, such as all that are not taken
    return out.withColumn("position", F.get("copies", F.lit(0))["position"]).orderBy(F.col("position").asc_nulls_last(), "draw").drop("draw")


def sequence_of(rows: DataFrame) -> DataFrame:
    """The training sequence of ``mixed``: a row for each taking of a document, range-sorted by position."""
    told = rows.select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.time", "c.words", "c.position")
    return told.orderBy("position", "source", "doc_id", "time", "words")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``, mixed by the weights 1, 2, 3 and the default curriculum."""
    told = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return told.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


#: What SQL tells of the same mix: takings from the running sum of sizes, positions from the integrated schedules.
ORACLE = r"""
    WITH RECURSIVE held AS (
        SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw
        FROM documents
    ), sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS turn FROM held GROUP BY source
    ), level(n, share, stopped) AS (
        SELECT 0, CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) / (SELECT sum(turn + 1) FROM sources), 0
        UNION ALL
        SELECT n + 1,
            CAST((SELECT sum(source_size) FROM sources) - (SELECT coalesce(sum(3 * source_size), 0) FROM sources WHERE 3 * source_size < share * (turn + 1)) AS DOUBLE)
                / (SELECT sum(turn + 1) FROM sources WHERE 3 * source_size >= share * (turn + 1)),
            (SELECT count(*) FROM sources WHERE 3 * source_size < share * (turn + 1))
        FROM level WHERE n < 100 AND (SELECT count(*) FROM sources WHERE 3 * source_size < share * (turn + 1)) > stopped
    ), final AS (
        SELECT count(*) FILTER (WHERE 3 * source_size < share * (turn + 1)) AS n, (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size < share * (turn + 1)), 0) AS rest,
            sum(turn + 1) FILTER (WHERE 3 * source_size >= share * (turn + 1)) AS sharing, min(share) AS share
        FROM sources, (SELECT share FROM level ORDER BY n DESC LIMIT 1)
    ), aimed AS (
        SELECT source, source_size, turn, CASE WHEN 3 * source_size < share * (turn + 1) THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((turn + 1) * rest AS DOUBLE) / CAST(sharing AS DOUBLE) END AS target FROM sources, final
    ), placed AS (
        SELECT h.*, source_size, turn, target, CAST(floor(target) AS BIGINT) AS wanted,
            CAST(coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS passed
        FROM held h JOIN aimed a ON h.source IS NOT DISTINCT FROM a.source
    ), counted AS (
        SELECT *, greatest(0, least(size, wanted - passed)) AS first_words,
            greatest(0, least(size, wanted - passed)) + greatest(0, least(size, wanted - source_size - passed)) + greatest(0, least(size, wanted - 2 * source_size - passed)) + greatest(0, least(size, wanted - 3 * source_size - passed)) AS taken
        FROM placed
    ), demanded AS (
        SELECT *, CASE WHEN first_words > 0 THEN (passed + first_words / 2) / wanted END AS y FROM counted
    )
    SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
        round(CASE turn
            WHEN 0 THEN 2 * y / (sqrt(2.25 - 2 * y) + 1.5)
            WHEN 1 THEN CASE WHEN y <= 0.5 THEN 2 * y / (sqrt(0.64 + 1.6 * y) + 0.8) ELSE 0.5 + 2 * (y - 0.5) / (sqrt(greatest(0, 1.44 - 1.6 * (y - 0.5))) + 1.2) END
            ELSE 2 * y / (sqrt(0.25 + 2 * y) + 0.5)
        END, 9) AS position
    FROM demanded
"""
