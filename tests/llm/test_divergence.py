"""The audit against full tables in plain Python, and edge rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from inkspan.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least=10, top=10):
    used = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for lang, source, text in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in used:
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {x[0] for x in used}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted({s for x, s, _ in used if x == lang})
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        p_of = lambda own: {t: 1 + 10**9 * (own[t] + 2) // (sum(own[k] for k in kept) + 2 * len(kept)) for t in kept}
        q, shares = p_of(whole), {s: p_of(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(shares[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and shares[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def made(seed, n, vocabulary, langs, sources):
    rng = random.Random(seed)
    return [(rng.choice(langs), rng.choice(sources), rng.choice([" ", ", ", "\n1 "]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(0, 60)))) for _ in range(n)]


CASES = {
    "words": made(1, 400, [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["en", "fr"], ["a", "b", "c", "d", "É"]),
    "few terms": made(2, 200, ["A", "b", "ß", "漢字", "Ünï", "x_y", "İ"], ["en", None, ""], ["s", None, "", "t"]),
    "ties": [("en", f"s{i % 4}", " ".join(f"w{chr(97 + j)}{chr(97 + k)}" for j in range(5) for k in range(5))) for i in range(40)] + [("en", "odd", "zz " * 3)] * 12,
    "edges": [(None, None, None), ("de", "only", "a b"), ("fr", "a", ""), ("fr", "b", "x"), ("en", "a", "w " * 120_000)] + [("en", "b", "w v")] * 11,
    "hot": made(3, 300, [f"k{chr(97 + i)}" for i in range(20)], ["en"], ["hot"] * 9 + [f"r{i}" for i in range(30)]),
}


@pytest.mark.parametrize("case", CASES)
def test_audit_equals_full_tables(spark, case):
    docs = spark.createDataFrame([(*r, 1, "x") for r in CASES[case]], "lang string, source string, text string, n int, part string").repartition(3)
    assert sorted(map(tuple, D.divergence(docs).collect())) == slow(CASES[case])


def test_other_limits(spark):
    docs = spark.createDataFrame(CASES["words"], "lang string, source string, text string")
    assert sorted(map(tuple, D.divergence(docs, 2, 3).collect())) == slow(CASES["words"], 2, 3)


def test_no_documents(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shut_buckets_hold_no_great_term(spark):
    """Not all buckets are opened, and each open one's bound is reached by a term."""
    docs = spark.createDataFrame(CASES["words"], "lang string, source string, text string")
    _, cells = D.groups_and_cells(D.term_counts(docs), 2)
    opened, rows = D.opened_buckets(cells, 3).collect(), cells.where("p > q").collect()
    assert len(opened) < len({(r.lang, r.source, r.n) for r in rows})
    reached = defaultdict(int)
    for r in rows:
        reached[r.lang, r.source, r.n] = max(reached[r.lang, r.source, r.n], (r.p - r.q) ** 2 // (r.p + r.q))
    assert all(reached[r.lang, r.source, r.n] == r.bound >= r.kth for r in opened)


def test_shared_sums_in_slices(spark):
    import pandas as pd

    rng = random.Random(4)
    rows = pd.DataFrame([(f"s{s}", f"t{t}", rng.randrange(1, 10**9), 5 + s) for t in range(40) for s in range(9) if rng.random() < 0.6], columns=["source", "term", "p", "p0"])
    whole, cut = D.shared_sums(rows), D.shared_sums(rows, 7)
    assert whole.equals(cut) and len(whole) == 36


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    told = con.execute(D.ORACLE)
    at = [d[0] for d in told.description]
    df = D.op12_divergence(spark, sf_dir)
    assert Counter(tuple(r[c] for c in at) for r in df.collect()) == Counter(told.fetchall())
