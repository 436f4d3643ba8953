"""Periodic runs of words in whole texts, by longest previous factors.

The suffix array of a lot of documents and its LCP array give, for each word, the longest factor that also starts earlier in
its document (LPF) and where; LPF cuts a document into Lempel-Ziv blocks. A run that touches the boundary of two blocks is
found by Main's extensions: for each period that can stand there, how far the words agree to the right and to the left of the
boundary. A run strictly inside a block also lies in the block's earlier occurrence; it is copied from there, through buckets
of runs by their first word.

Bounds that make the boundaries' work linear: of a run that ends in block h and does not lie strictly inside it, the period is
at most the length of block h if it stands to the right of the boundary, and at most the lengths of blocks h-1 and h together
if it stands to the left (with a longer period, block h-1 would have reached further).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words of a lot, whose arrays are made together; a longer document is a lot of its own.
LOT = 1 << 18
#: Periods that are tried at once.
SLICE = 1 << 20

COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def edited_words(text: str, doc_id: int | None) -> list[bytes]:
    """The words of a text; of one document in ten the words from some word on repeat with a period, as its id's checksum says.

    A document without an id keeps its words.
    """
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at 0x09-0x0D and 0x20, no others
    if words and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
    return words


def ranked(docs: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, levels, ends) of a lot. Each document is followed by an end mark, whose place is in ``ends``.

    ``order`` is the suffix array, documents one after the other. ``levels[k][i]`` is equal for two places if, and only if,
    the 2^k symbols from there on are equal and of one document. Doubling sorts only what is not yet told apart.
    """
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    ends = np.cumsum(sizes) - 1
    symbols: list[int] = []
    most = 1
    for words in docs:
        known: dict[bytes, int] = {}
        symbols += [known.setdefault(w, len(known) + 1) for w in words]
        symbols.append(0)
        most = max(most, len(known) + 1)
    n = len(symbols)
    key = np.array(symbols, np.int64) + np.repeat(np.arange(len(docs), dtype=np.int64) * most, sizes)
    order = np.argsort(key, kind="stable")
    rank, levels = np.empty(n, np.int32), []

    def grouped(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys, whose place in the order is ``at``: the first place of each one's group, and whether it is alone."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        return at[np.flatnonzero(new)][np.cumsum(new) - 1], alone

    at = np.arange(n)
    head, alone = grouped(key[order], at)
    rank[order] = head
    levels.append(rank)
    width = 1
    while not alone.all():
        at = at[~alone]
        here = order[at]
        key = levels[-1][here].astype(np.int64) * n + levels[-1][here + width]
        turn = np.argsort(key, kind="stable")
        order[at] = here[turn]
        head, alone = grouped(key[turn], at)
        rank = levels[-1].copy()
        rank[order[at]] = head
        levels.append(rank)
        width *= 2
    return order, levels, ends


def agreeing(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many symbols agree from i and j on, i and j included; backward: up to i and j."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        if backward:
            a, b = i - out - width + 1, j - out - width + 1
            same = (a >= 0) & (b >= 0)
            same[same] = level[a[same]] == level[b[same]]
        else:
            # Whatever agrees so far ends before an end mark, so both places exist
            same = level[i + out] == level[j + out]
        out[same] += width
    return out


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """LPF and the earlier place of each place, from a suffix array and lcp (of each entry with the one before it).

    The nearest smaller places above and below in the suffix array are the two candidates; a stack of growing places meets both.
    """
    n = len(order)
    factor, source = [0] * n, [-1] * n
    places: list[int] = []
    shared: list[int] = []
    for place, common in zip([*order.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while places and places[-1] > place:
            top, above = places.pop(), shared.pop()
            if above >= common:
                if above:
                    factor[top], source[top] = above, places[-1]
            else:
                factor[top], source[top] = common, place
                common = above
        places.append(place)
        shared.append(common)
    return factor, source


def blocks_of(factor: list[int], first: int, end: int) -> list[int]:
    """Where the Lempel-Ziv blocks of a document start."""
    out, at = [], first
    while at < end:
        out.append(at)
        at += factor[at] or 1
    return out


def least_needed(min_length: int, min_periods: int) -> int:
    """The least that one of a run's two extensions reaches, whatever its period."""
    return max(1, min(-(-max((min_periods - 1) * p, min_length - p) // 2) for p in range(1, max(2, min_length + 1))))


def boundary_runs(levels: list[np.ndarray], bounds: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    """Rows (start, end, period) of the maximal repetitions that touch a boundary; a period may be a multiple of the smallest.

    ``before`` and ``after`` are the lengths of the blocks at each boundary, ``first`` the start of its document.
    """
    level = min(least_needed(min_length, min_periods).bit_length() - 1, len(levels) - 1)
    probe, width, found = levels[level], 1 << level, []
    for left in (False, True):
        most = np.minimum(before + after, bounds - first) if left else after
        upto = np.cumsum(most)
        for low in range(0, int(upto[-1]) if len(upto) else 0, SLICE):
            flat = np.arange(low, min(low + SLICE, int(upto[-1])))
            at = np.searchsorted(upto, flat, side="right")
            period = flat - (upto[at] - most[at]) + 1
            i = bounds[at] - period * left
            j = i + period
            # One of the two extensions is at least as long as the probe
            likely = probe[i] == probe[j]
            reach = np.maximum(i - width, 0)
            likely |= (i >= width) & (probe[reach] == probe[np.maximum(j - width, 0)])
            i, j, period = i[likely], j[likely], period[likely]
            forward, backward = agreeing(levels, i, j), agreeing(levels, i - 1, j - 1, backward=True)
            start, stop = i - backward, j + forward
            held = stop - start >= np.maximum(min_length, min_periods * period)
            found.append(np.stack([start[held], stop[held], period[held]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_periods(rows: np.ndarray) -> np.ndarray:
    """One row of each (start, end), that of the least period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    return rows[new]


def copied_runs(found: list[tuple[int, int, int]], blocks: list[int], end: int, factor: list[int], source: list[int], min_length: int) -> list[tuple[int, int, int]]:
    """``found``, the boundary runs of a document, and the runs strictly inside its blocks, ordered by start and end."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, stop, period in found:
        buckets.setdefault(start, []).append((stop, period))
    for block in blocks:
        length = factor[block]
        if length < min_length + 2:
            continue
        origin = source[block]
        shift, last = block - origin, origin + length
        # Buckets are met in rising order, so what is copied into the origin itself (an overlap) is copied on
        for start in range(origin + 1, last - min_length):
            for stop, period in buckets.get(start, ()):
                if stop < last:
                    buckets.setdefault(start + shift, []).append((stop + shift, period))
    return sorted((start, stop, period) for start, held in buckets.items() for stop, period in held)


def runs_of(docs: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Of each document the runs (first word, word after the last, smallest period), ordered by start and period."""
    if not any(docs):
        return [[] for _ in docs]
    order, levels, ends = ranked(docs)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = agreeing(levels, order[:-1], order[1:])
    factor, source = previous_factors(order, lcp)
    firsts = np.concatenate([[0], ends[:-1] + 1])
    cuts = [blocks_of(factor, a, b) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
    bounds, before, after, first = ([] for _ in range(4))
    for a, b, blocks in zip(firsts.tolist(), ends.tolist(), cuts, strict=True):
        if blocks:
            edges = [*blocks[1:], b]
            bounds += edges
            before += [y - x for x, y in zip(blocks, edges, strict=True)]
            after += [y - x for x, y in zip(edges, edges[1:], strict=False)] + [0]
            first += [a] * len(edges)
    found = least_periods(boundary_runs(levels, *(np.array(x, np.int64) for x in (bounds, before, after, first)), min_length, min_periods))
    of_doc = np.searchsorted(ends, found[:, 0])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d in np.unique(of_doc).tolist():
        own = [tuple(r) for r in found[of_doc == d].tolist()]
        a = int(firsts[d])
        out[d] = [(x - a, y - a, p) for x, y, p in copied_runs(own, cuts[d], int(ends[d]), factor, source, min_length)]
        out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    turn = np.zeros(len(words) + 1, np.int64)
    for start, stop, period in runs:
        turn[start + period] += 1
        turn[stop] -= 1
    kept = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    told = "".join(f"{a},{b - a},{p}\n" for a, b, p in runs)
    digests = (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())
    if not runs:
        return (doc_id, 0, None, None, None, None, *digests)
    best = runs[0]
    for run in runs[1:]:
        gain = (run[1] - run[0]) * best[2] - (best[1] - best[0]) * run[2]
        if gain > 0 or (gain == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    start, stop, period = best
    return (doc_id, len(runs), start, stop - start, period, 1000 * (stop - start) // period, *digests)


def _batches(batches: Iterator[pa.RecordBatch], edit: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split(" ") for c in COLUMNS.split(", "))])

    def told(ids: list[int | None], lot: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_row(*x) for x in zip(ids, lot, runs_of(lot), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        ids, lot, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = edited_words(text.as_py() or "", doc_id if edit else None)
            if lot and held + len(words) > LOT:
                yield told(ids, lot)
                ids, lot, held = [], [], 0
            ids.append(doc_id)
            lot.append(words)
            held += len(words)
        if lot:
            yield told(ids, lot)


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs of words, the greatest one, and digests (see COLUMNS).

    A run is a longest stretch of words with smallest period q, of at least 24 words and three periods. A null or empty text
    has none: no runs, nulls, digests of empty strings. Ties of exponent go to the smaller start, then period. Rows of one id are
    told apart; a null id stays null (and is not edited); other columns are ignored. No documents give no rows. A text is
    read whole: one task needs some 4 x 2 x log2(longest repeat) bytes a word of its lot. No shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _batches(batches, edit), COLUMNS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, of which one in ten is first edited to repeat itself."""
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=True)
