"""The mix against a plain loop over documents, schedules against their integrals, and edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from inkspan.llm import mixing as M


def slow_targets(sizes, weights=M.WEIGHTS, most=3):
    """Targets by resharing the excess until none is above; ``sizes`` by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(most * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if most * sizes[s] < share[s]}
        if not above:
            return share | {s: float(most * sizes[s]) for s in stopped}
        stopped |= above


def slow_mix(rows):
    """(doc_id, size, source_size, target, taken) of each row."""
    held = [(i, s, len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in rows]
    sizes = Counter()
    for _, s, n, _ in held:
        sizes[s] += n
    target, out, streams = slow_targets(sizes), [], defaultdict(list)
    for row in held:
        streams[row[1]].append(row)
    for source, own in streams.items():
        own.sort(key=lambda r: (r[3], r[2]))
        left, taken = int(target[source]), [0] * len(own)
        for _ in range(4):
            for k, (_, _, n, _) in enumerate(own):
                taken[k] += min(n, left)
                left -= min(n, left)
        out += [(r[0], r[2], sizes[source], round(target[source], 6), t) for r, t in zip(own, taken, strict=True)]
    return out


def made(rng, n, sources):
    return [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice(sources)) for i in range(n)]


CASES = {
    "uneven": made(random.Random(1), 300, ["a", "a", "a", "a", "a", "a", "a", "a", "b", "c", "", None]),
    "one source": made(random.Random(2), 20, ["x"]),
    "edges": [(1, None, None), (2, "", "s"), (None, "a b c", "s"), (3, "a\tb\x0bc d", "t"), (3, "a b", "t"), (3, "a b", "t"), (4, "w " * 120_000, "u"), (5, "Ünï 漢字", "é"), (6, " ", "z")],
    "no words": [(1, "", "a"), (2, None, None)],
    "tiny sources": [(i, "w " * (1 + 50 * (i == 0)), f"s{i:02}") for i in range(40)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("part", [3, M.PART])
def test_mix_equals_a_plain_loop(spark, case, part):
    rows = CASES[case]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, part string").repartition(3)
    mixed = M.mixed(docs, part=part)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()]
    assert sorted(got, key=repr) == sorted(slow_mix(rows), key=repr)
    takings = M.sequence_of(mixed).collect()
    assert sum(r.words for r in takings) == sum(g[4] for g in got)
    assert all(0 <= r.position <= 1 for r in takings) and [r.position for r in takings] == sorted(r.position for r in takings)


def test_no_documents(spark):
    assert M.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


@pytest.mark.parametrize("knots", [*M.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 0.0), (0.75, 0.0), (1.0, 3.0))])
def test_times_invert_the_integral(spark, knots):
    area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) / (b[0] - a[0]) * (min(t, b[0]) - a[0])) / 2 for a, b in zip(knots, knots[1:], strict=False) if t > a[0])
    rows = spark.range(0, 1001).select((M.F.col("id") / 1000).alias("y"), M.F.lit(0).alias("turn"))
    told = rows.select("y", M.time_of(M.F.col("y"), M.F.col("turn"), (knots,)).alias("t")).orderBy("y").collect()
    assert all(abs(area(r.t) / area(1.0) - r.y) < 1e-9 for r in told)
    assert [r.t for r in told] == sorted(r.t for r in told)


def test_schedules_are_checked():
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.0, 1.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            M.pieces_of(bad)


def test_heavier_sources_come_later(spark, sf_dir):
    from inkspan.llm.common import table

    rows = M.sequence_of(M.mixed(table(spark, sf_dir, "documents"))).collect()
    names = sorted({r.source for r in rows})
    mean = {turn: [sum(r.position * r.words for r in own) / sum(r.words for r in own) for own in [[r for r in rows if names.index(r.source) % 3 == turn]]][0] for turn in range(3)}
    assert mean[0] < mean[1] < mean[2]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    told = con.execute(M.ORACLE)
    at = [d[0] for d in told.description]
    df = M.op13_mixing(spark, sf_dir)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[c]) for c in at) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in told.fetchall())
