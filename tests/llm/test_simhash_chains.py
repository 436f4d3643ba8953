"""Keys of two and of three segments, heavy keys, and what the chains remove before the full distance."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import simhash


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def clustered(n, seed):
    """Fingerprints near a few centres, and others that share the first half of their bits."""
    rnd, out = random.Random(seed), set()
    for _ in range(n):
        x = rnd.getrandbits(64)
        out.add(x)
        for _ in range(3):
            y = x
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                y ^= 1 << bit
            out.add(y)
        out.add((0xABCDEF0123456789 >> 32 << 32) | x >> 32)
    return sorted(out)


def parts(values, links):
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in links:
        label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("chain", "tile"), [(2, 512), (2, 8), (3, 512), (3, 8)])
def test_keys_of_both_lengths_link_what_brute_force_links(spark, chain, tile):
    values = clustered(60, 3)
    want = {(signed(a), signed(b)) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {tuple(r) for r in simhash.near_links(fps, tile=tile, chain=chain).collect()}
    own = [signed(v) for v in values]
    assert parts(own, got) == parts(own, want) and want
    near = {(a, b) for a, b in got if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert near == got


def test_chains_prune_most_candidates(spark):
    """Of fingerprints that share two segments, few also keep within the budgets of three and four."""
    fps = spark.createDataFrame([(signed(v),) for v in clustered(150, 4)], "fp long")
    met = simhash.candidates(fps)
    holds = simhash.chain_holds(F.col("start"), F.col("differing"))
    all_of, held, linked = met.agg(*[F.count(F.when(c, 1)) for c in (F.lit(True), holds, holds & (F.bit_count("differing") <= 4))]).first()
    assert 0 < linked <= held < all_of / 10
    assert met.where(~simhash.chain_holds(F.col("start"), F.col("differing"))).select("a", "b").distinct().count() > 0


def test_chains_of_arrays_and_of_columns_agree(spark):
    rnd = random.Random(6)
    values = [sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for _ in range(500)]
    rows = spark.createDataFrame([(s, signed(v)) for s in range(5) for v in values], "start int, d long")
    got = {(r.start, r.d): r.h for r in rows.select("start", "d", simhash.chain_holds(F.col("start"), F.col("d")).alias("h")).collect()}
    for s in range(5):
        for v, holds in zip(values, simhash.chains_hold(np.array(values, np.uint64), s, 4), strict=True):
            assert got[s, signed(v)] == holds


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "a b c d e " * 100_000), (2, "a b c d e " * 100_000), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit("x"), "component": F.lit(0), "least": F.lit(9)})
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
