"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts that the links of one node are dealt over, so that a node of very many links is no key of one task.
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node's neighbours are hung on the least of them: the greater ones (large) or the smaller ones and the node itself (small)."""
    if large:
        sides = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = sides.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt, ["a", "salt"]).drop("salt")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type); component is the least node reachable.

    Null ends and self-links are ignored; repeated links count once. No links give no rows. Each round is written to the
    checkpoint folder, so a lost executor costs one round at most. The number of rounds grows with the logarithm of the
    longest path. The links of a node are dealt over ``SALTS`` tasks, to each of which its least neighbour is told.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, large=True), large=False))
        # A star forest is a fixed point: no parent is a child. The sums tell one round's links from the next's.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
