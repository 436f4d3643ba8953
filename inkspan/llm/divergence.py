"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from each other.

Terms are counted where the texts are and shuffled as sums. A language keeps the terms of enough of its documents; every group
(a language's source) gives each kept term a smoothed share in parts of 10^9, whole numbers throughout.

- Greatest terms: a group's terms fall into buckets by their count, so that all terms of a bucket have one share p. With the
  least of its language's shares q, a bucket bounds its terms' divergence f from above, and one term of it reaches that bound.
  Best-first, buckets are opened from the highest bound on until k terms are certain; a bucket stays shut if its bound is
  strictly below the k-th of them. Only the terms of open buckets are evaluated and ranked.
- Pairs of sources: f of a term that neither has is one number for the pair; of a term that one of them has, it follows from
  the counts of that one's buckets. Only terms that both have need the term's posting list: what they differ by is summed in
  tasks that hold a share of the terms each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

MIN_DOCUMENTS, TOP = 10, 10
#: Shares are parts of this whole.
WHOLE = 1_000_000_000
#: Rows of counts that a task holds before it sends them on.
HELD = 1 << 18
#: Parts that the one row of a group is given to, so that a large group meets it in many tasks.
SALTS = 32
#: Postings of one task.
POSTINGS = 1 << 17

#: Bytes that are no part of a term, and the fold of A-Z.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included: runs of ASCII letters and of whatever is beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, seen = list(own), docs[lang, source]
            n = len(terms) + 1  # and a row without a term, which tells that the group occurs
            columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *(seen[t] for t in terms)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
            own = terms_of(text.as_py())
            counts[lang, source].update(own)
            docs[lang, source].update(set(own))
        if sum(map(len, counts.values())) > HELD:
            yield from told()
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and its documents there, and one row with a null term of each group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_sql(count: str, total: str, kept: str) -> str:
    """1 + floor(WHOLE (count + 2) / (total + 2 kept)), exactly; null if nothing is kept."""
    return f"CASE WHEN {kept} > 0 THEN 1 + CAST((CAST({count} AS DECIMAL(20,0)) + 2) * {WHOLE} AS DECIMAL(38,0)) DIV CAST({total} + 2 * {kept} AS DECIMAL(20,0)) END"


def divergence_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV ({p} + {q}))"


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def groups_and_cells(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Of ``term_counts``: groups (lang, source, kept, total, lang_total, p0) and cells (lang, source, term, n, p, q) of kept terms that a group has."""
    counts = cut(counts)
    by_term = Window.partitionBy("lang", "term")
    told = counts.where("term is not null").withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term), "first": (F.min("source").over(by_term) == F.col("source")).cast("long")})
    kept = cut(told.where(F.col("lang_docs") >= min_documents).select("lang", "source", "term", "n", "lang_n", "first"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    langs = totals.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("total").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").join(totals.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "total", "lang_total")])
    groups = cut(groups.withColumn("p0", F.expr(share_sql("0", "total", "kept"))))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    cells = salted.join(_salted(groups), ["lang", "source", "salt"])
    p, q = share_sql("n", "total", "kept"), share_sql("lang_n", "lang_total", "kept")
    return groups, cut(cells.select("lang", "source", "term", "n", F.expr(p).alias("p"), F.expr(q).alias("q"), "p0"))


def opened_buckets(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, n, terms, bound, kth) of the count buckets that must be opened.

    Of the buckets in the order of their bounds the first ``top`` make as many terms certain, since each has a term that
    reaches its bound; the last of these bounds is ``kth``. All buckets whose bound is not strictly below it are opened.
    """
    bound = divergence_sql("p", "min(q)")
    buckets = cells.where("p > q").groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("terms"), F.expr(bound).alias("bound"))
    of_group = Window.partitionBy("lang", "source")
    ranked = buckets.withColumn("place", F.row_number().over(of_group.orderBy(F.col("bound").desc(), F.col("n").desc())))
    told = ranked.withColumn("kth", F.coalesce(F.max(F.when(F.col("place") == top, F.col("bound"))).over(of_group), F.lit(0)))
    return told.where("bound >= kth").select("lang", "source", "n", "terms", "bound", "kth")


def greatest_terms(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of each group's ``top`` terms of greatest divergence from its language, with p > q."""
    salted = cells.where("p > q").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    opened = salted.join(_salted(opened_buckets(cells, top).select("lang", "source", "n", "kth")), ["lang", "source", "n", "salt"])
    valued = opened.select("lang", "source", F.col("term").alias("item"), F.expr(divergence_sql("p", "q")).alias("value"), "kth").where("value >= kth")
    return _ranked(valued.drop("kth")).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the whole sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_sums(postings, slice_size: int = 1 << 20):
    """Of the postings (source, term, p, p0) of some terms of one language: for each two sources (a < b) with a term in common,
    by how much the terms they share change their sum from what either one's counts alone tell."""
    import pandas as pd

    names, of_source = np.unique(postings["source"].to_numpy(dtype=object).astype(str), return_inverse=True)
    _, of_term = np.unique(postings["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
    order = np.lexsort((of_source, of_term))
    source, term, p, p0 = of_source[order].astype(np.int64), of_term[order], postings["p"].to_numpy()[order], postings["p0"].to_numpy()[order]
    after = np.searchsorted(term, term, side="right") - np.arange(len(term)) - 1  # postings of the same term that follow
    upto, keys, values = np.cumsum(after), [], []
    for low in range(0, int(upto[-1]) if len(upto) else 0, slice_size):
        flat = np.arange(low, min(low + slice_size, int(upto[-1])))
        i = np.searchsorted(upto, flat, side="right")
        j = i + 1 + flat - (upto[i] - after[i])
        change = _divergence(p[i], p[j]) - _divergence(p[i], p0[j]) - _divergence(p0[i], p[j]) + _divergence(p0[i], p0[j])
        k, v = summed(source[i] * len(names) + source[j], change)
        keys.append(k)
        values.append(v)
    k, v = summed(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pd.DataFrame({"a": names[k // len(names)].astype(object), "b": names[k % len(names)].astype(object), "shared": v})


def source_pairs(groups: DataFrame, cells: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(lang, source, item, value, rank): each group against each other source of its language, over all kept terms."""
    lots = max(1, -(-cells.count() // postings))

    def told(key, own):
        out = shared_sums(own)
        out.insert(0, "lang", key[0])
        return out

    dealt = cells.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(lots)).alias("lot"))
    shared = dealt.groupBy("lang", "lot").applyInPandas(told, "lang string, a string, b string, shared long").groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))
    buckets = cells.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("buckets"))
    held = cut(groups.select("lang", "source", "kept", "p0").join(buckets, ["lang", "source"], "left"))
    left = held.select("lang", "source", "kept", "p0", "buckets", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    right = _salted(held.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("buckets").alias("item_buckets")))
    pairs = left.join(right, ["lang", "salt"]).where("source <> item")
    neither = divergence_sql("p0", "q0")
    alone = lambda buckets, other: f"aggregate({buckets}, 0L, (a, x) -> a + x.terms * ({divergence_sql('x.p', other)} - {neither}))"
    rest = F.expr(f"kept * {neither} + coalesce({alone('buckets', 'q0')}, 0) + coalesce({alone('item_buckets', 'p0')}, 0)")
    valued = pairs.select("lang", "source", "item", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), F.coalesce(rest, F.lit(0)).alias("rest"))
    out = valued.join(shared, ["lang", "a", "b"], "left").select("lang", "source", "item", (F.col("rest") + F.coalesce("shared", F.lit(0))).alias("value"))
    return _ranked(out)


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of ``docs`` (lang, source, text): see the module.

    part ``pair``: each other source of the language, by the divergence over all kept terms, all ranks. part ``term``: the
    group's kept terms with a greater share than the language's, the first ``top``. Ties go to the lesser item. Null text,
    language and source are the empty string, a group like others; a group without kept terms has pairs and no terms; a
    language that keeps nothing has pairs of value 0; a language of one source has none. Repeated rows count each; texts
    are read whole; other columns are ignored. No documents give no rows. A group's buckets are as many as it has different
    counts, at most the root of twice its words.
    """
    groups, cells = groups_and_cells(term_counts(docs), min_documents)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, rows in (("pair", source_pairs(groups, cells)), ("term", greatest_terms(cells, top)))]
    return parts[0].unionAll(parts[1])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


#: The same from full tables of groups by terms.
ORACLE = r"""
    WITH held AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM documents
    ), used AS (
        SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM held
    ), kept AS (
        SELECT lang, term, count(*) AS n FROM used GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
    ), langs AS (
        SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang
    ), groups AS (
        SELECT DISTINCT lang, source FROM held
    ), counts AS (
        SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), totals AS (
        SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY lang, source
    ), cells AS (
        SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * v) AS p, 1 + 1000000000 * (k.n + 2) // (l.total + 2 * v) AS q
        FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
    ), summed AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
    ), told AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM told
    )
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
