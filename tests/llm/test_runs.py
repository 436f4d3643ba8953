"""Runs against a table of all stretches, and edge rows."""

import hashlib
import random
import re
import zlib

import pytest

from inkspan.llm import runs as R


def slow_runs(words, min_length=24, min_periods=3):
    """Every stretch that no neighbour extends, for each period, told apart by its smallest period."""
    n, found = len(words), {}
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_periods * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(a + p <= i < b for a, b, p in found)]
    best = max(found, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    told = [best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]] if best else [None] * 4
    return (doc_id, len(found), *told, hashlib.sha256("".join(f"{a},{b - a},{p}\n" for a, b, p in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def texts_of(rng, n):
    """Texts of few different words, of periods inside periods, and of both."""
    for _ in range(n):
        kind, letters = rng.randrange(5), [b"a", b"b", b"c", b"d"][: rng.randrange(1, 5)]
        size = rng.randrange(0, 90)
        if kind == 0:
            yield [rng.choice(letters) for _ in range(size)]
        elif kind == 1:
            word = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            yield (word * 40)[: rng.randrange(1, 120)]
        elif kind == 2:
            inner = ([rng.choice(letters) for _ in range(rng.randrange(1, 4))] * 9)[: rng.randrange(5, 20)] + [b"x"]
            yield (inner * 5)[: rng.randrange(1, 100)] + [b"y"] + (inner * 5)[: rng.randrange(1, 100)]
        elif kind == 3:
            part = [rng.choice(letters) for _ in range(rng.randrange(3, 30))]
            yield [w for _ in range(rng.randrange(1, 6)) for w in (*part, rng.choice(letters))]
        else:
            a, b = [b"a"], [b"b"]
            for _ in range(rng.randrange(1, 8)):
                a, b = a + b, a
            yield a


@pytest.mark.parametrize(("least", "periods"), [(1, 2), (2, 2), (4, 2), (6, 3), (24, 3)])
def test_runs_equal_the_table_of_stretches(least, periods):
    rng = random.Random(least * 10 + periods)
    docs = list(texts_of(rng, 900))
    for size in (1, 7, 150):
        for at in range(0, len(docs), size):
            if size == 1 and at > 300:
                break
            lot = docs[at : at + size]
            assert R.runs_of(lot, least, periods) == [slow_runs(w, least, periods) for w in lot]


def test_factors_are_the_longest_that_start_earlier():
    words = list(b"abaababaabaababaababa")
    docs = [[bytes([w]) for w in words]]
    order, levels, ends = R.ranked(docs)
    assert order.tolist() == sorted(range(len(words) + 1), key=lambda i: [w for w in docs[0][i:]] and [{b"a": 1, b"b": 2}[w] for w in docs[0][i:]])
    lcp = R.np.zeros(len(order), R.np.int64)
    lcp[1:] = R.agreeing(levels, order[:-1], order[1:])
    factor, source = R.previous_factors(order, lcp)
    for i in range(len(words)):
        same = lambda j: next((k for k in range(len(words) - i) if words[j + k] != words[i + k]), len(words) - i)
        assert factor[i] == max((same(j) for j in range(i)), default=0)
        assert factor[i] == 0 or (source[i] < i and same(source[i]) == factor[i])


def edited_ids(n=40):
    return [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:n]


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["le", "chat", "Ünï", "dort", "漢字", "x y", "z", "a-b"]
    rows = [(i, rng.choice([" ", "\n", "\t \x0b", "\x0c\r"]).join(rng.choice(vocabulary[: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 150)))) for i in [*edited_ids(), *range(60)]]
    rows += [(3, None), (4, ""), (None, "a b " * 30), (None, None), (7, " \n "), (8, "one"), (9, "a " * 50), (9, "a " * 50), (9, "b c " * 50), (-10, "p q r " * 9)]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, start string, period int").repartition(3)
    got = sorted(map(tuple, R.periodic_runs(docs, edit=True).collect()), key=repr)
    assert got == sorted((slow_row(*r) for r in rows), key=repr)
    assert R.periodic_runs(docs.limit(0)).collect() == []


def test_long_texts_take_linear_time():
    """300,000 equal words, as many of a Fibonacci text, and one text of 100,000 characters and more without a run."""
    n = 300_000
    assert R.runs_of([[b"a"] * n]) == [[(0, n, 1)]]
    assert R.runs_of([[b"a"] * n, [b"b"] * n, []])[1] == [(0, n, 1)]
    a, b = [b"a"], [b"b"]
    while len(a) < 100_000:
        a, b = a + b, a
    assert len(R.runs_of([a])[0]) > 10_000
    assert R.runs_of([[str(i).encode() for i in range(n)]]) == [[]]
