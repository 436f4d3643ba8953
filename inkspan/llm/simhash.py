"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into SEGMENTS consecutive segments, on a ring. If two fingerprints differ in at most MAX_BITS bits,
there is a segment from which on every chain of consecutive segments keeps within its proportional budget: c segments hold
floor(c * MAX_BITS / SEGMENTS) differences at most. With 5 segments and 4 bits the first segment of such a chain is equal and
the second differs in one bit at most, so the candidates of each start meet on a key of two segments, one side with each
single bit of the second turned. Of very many fingerprints too many would share such a key by chance; they meet on three
segments, of which the second and third differ in two bits at most, so that both sides turn each single bit. Longer chains
prune the candidates, before the full distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import connected_components

BITS, SHINGLE, SEED = 64, 4, 42
MAX_BITS, SEGMENTS = 4, 5
#: A key with more fingerprints than this is compared in tiles of this many, each pair of tiles a task's group of its own.
TILE = 512
#: From this many fingerprints on, keys are chains of three segments. Links are the same, fewer candidates are noise.
LONG_KEYS_FROM = 1 << 26
#: Parts that a join on the names of components is dealt over, so that a large component is no key of one task.
SALTS = 16

#: What divides words.
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE, max_slice: int = 65536) -> int:
    """Signed 64-bit majority fingerprint of a text's word shingles; 0 without words."""
    import xxhash

    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[-n:] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, max_slice):
        ones += np.unpackbits(hashes[at : at + max_slice].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, row_key: bool = False) -> DataFrame:
    """(doc_id, fp), and the rows' own ``row_key``, a string, if it is wanted."""
    small_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col("row_key")] * row_key]
    return docs.select(*columns).mapInArrow(_fingerprints, "doc_id long, fp long" + ", row_key string" * row_key)


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [i * BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(low: int, width: int) -> int:
    value = ((1 << width) - 1) << low
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keyed(fps: DataFrame, max_bits: int, segments: int, turned: bool, chain: int = 2) -> DataFrame:
    """(start, key, fp): for each start of a chain, the bits of its first segments; turned: and with each bit beyond the first segment turned.

    A chain of two is met if one side is turned, a chain of three if both are.
    """
    if max_bits >= segments or chain * max_bits // segments >= chain:
        raise ValueError("the first segment of a chain must be equal, and each longer one within a bit a segment")
    bounds, entries = segment_bounds(segments), []
    for i in range(segments):
        held = [bounds[(i + c) % segments] for c in range(chain)]
        all_of = 0
        for low, width in held:
            all_of |= ((1 << width) - 1) << low
        key = F.col("fp").bitwiseAND(F.lit(all_of - (1 << BITS) if all_of >> (BITS - 1) else all_of))
        flips = [0] + ([_mask(b, 1) for low, width in held[1:] for b in range(low, low + width)] if turned and chain * max_bits // segments else [])
        entries.append(F.struct(F.lit(i).cast("byte").alias("start"), F.array(*[key.bitwiseXOR(F.lit(f).cast("long")) for f in flips]).alias("keys")))
    return fps.select("fp", F.inline(F.array(*entries))).select("start", F.explode("keys").alias("key"), "fp")


def chain_holds(start: Column, differing: Column, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> Column:
    """Every chain from ``start`` on, but the whole ring, keeps within its budget."""
    bounds, per_start = segment_bounds(segments), []
    for i in range(segments):
        mask, holds = 0, F.lit(True)
        for c in range(1, segments):
            low, width = bounds[(i + c - 1) % segments]
            mask |= ((1 << width) - 1) << low
            signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
            if c > 1:
                holds = holds & (F.bit_count(differing.bitwiseAND(F.lit(signed))) <= c * max_bits // segments)
        per_start.append((i, holds))
    out = F.lit(False)
    for i, holds in per_start:
        out = F.when(start == i, holds).otherwise(out)
    return out


def _tiles(rows: DataFrame, heavy: DataFrame, tile: int) -> DataFrame:
    """Each fingerprint of a heavy key to every pair of tiles that its own tile is in."""
    held = rows.join(heavy, ["start", "key"]).distinct()
    held = held.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return pairs.select("start", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def spanning_links(values: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together all that links of a group would: each member and the least of its part. near(rows) tells their neighbours."""
    label = np.arange(len(values))
    blocks = [(a, near(slice(a, a + 256))) for a in range(0, len(values), 256)]
    while True:
        before = label.copy()
        for a, close in blocks:
            least = np.where(close, label[None, :], len(values)).min(axis=1)
            label[a : a + 256] = np.minimum(label[a : a + 256], least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def chains_hold(differing: np.ndarray, start: int, max_bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """``chain_holds`` of an array, for the start of one key."""
    bounds, mask, holds = segment_bounds(segments), 0, np.ones(differing.shape, bool)
    for c in range(1, segments):
        low, width = bounds[(start + c - 1) % segments]
        mask |= ((1 << width) - 1) << low
        if c > 1:
            holds &= np.bitwise_count(differing & np.uint64(mask)) <= c * max_bits // segments
    return holds


def heavy_links(tiles: DataFrame, max_bits: int, segments: int = SEGMENTS) -> DataFrame:
    """Spanning links of each pair of tiles. A key's chains prune before the full distance; what they leave out meets at another start."""

    def link(pdf):
        import pandas as pd

        fps, start = np.unique(pdf["fp"].to_numpy()), int(pdf["start"].iat[0])
        bits = fps.view(np.uint64)

        def near(rows: slice) -> np.ndarray:
            differing = bits[rows, None] ^ bits[None, :]
            close = chains_hold(differing, start, max_bits, segments)
            close[close] = np.bitwise_count(differing[close]) <= max_bits
            return close

        a, b = spanning_links(fps, near)
        return pd.DataFrame({"a": a, "b": b})

    return tiles.groupBy("start", "key", "i", "j").applyInPandas(link, "a long, b long")


def candidates(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, chain: int = 2, heavy: DataFrame | None = None) -> DataFrame:
    """(start, a, b, differing) of fingerprints that meet on a key of ``chain`` segments, those of ``heavy`` keys aside."""
    base, turned = (_keyed(fps, max_bits, segments, t, chain) for t in (chain > 2, True))
    if heavy is not None:
        base = base.join(heavy, ["start", "key"], "left_anti")
    met = base.withColumnRenamed("fp", "a").join(turned.withColumnRenamed("fp", "b"), ["start", "key"]).where("a < b")
    return met.select("start", "a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("differing"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, tile: int = TILE, chain: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect whatever differs in ``max_bits`` bits or fewer.

    A key that few fingerprints share gives its pairs; a key that more than ``tile`` share is compared in pairs of tiles,
    each of which gives a spanning forest of its links, so no group's pairs are all emitted and no group meets in one task.
    """
    base, turned = (_keyed(fps, max_bits, segments, t, chain) for t in (chain > 2, True))
    heavy = cut(base.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile))
    parts = []
    if not heavy.isEmpty():
        parts.append(heavy_links(_tiles(base.unionAll(turned) if chain == 2 else turned, heavy, tile), max_bits, segments))
    met = candidates(fps, max_bits, segments, chain, heavy if parts else None)
    pairs = met.where(chain_holds(F.col("start"), F.col("differing"), max_bits, segments)).where(F.bit_count("differing") <= max_bits)
    parts.append(pairs.select("a", "b"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def roots_of(marked: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """fp, root (a fingerprint that names its component) and component_id (the least doc_id there, null if none has one).

    A fingerprint without links is its own component and takes part in no join; the others find their component's name in
    ``SALTS`` parts, so that a large component is not one task's.
    """
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(nodes.select("fp"), max_bits, tile=tile, chain=3 if nodes.count() >= LONG_KEYS_FROM else 2)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left")
    alone = placed.where("component is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    linked = placed.where("component is not null").select("fp", "least", F.col("component").alias("root"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.unionAll(linked.join(named, ["root", "salt"]).select("fp", "root", "component_id"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """(row_key, n) of the row that stands for each component of ``docs`` (doc_id, text, row_key): the least id, of equal ids
    the least key, rows without an id last. n rows have that key."""
    marked = cut(fingerprints(docs, row_key=True))
    rows = marked.groupBy("fp", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "n")
    return cut(rows.join(roots_of(marked).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("k")).select("k.row_key", "k.n"))


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable over links, itself included).

    Equal fingerprints are one node, whatever number of documents share it. A null text counts as empty: fingerprint zero,
    linked like any other; a text of any length is read whole. Rows of equal ids are each fingerprinted; other columns are
    ignored. A row without an id gets the component of its
    fingerprint and is never a component's id (null where no row there has one). No documents give no rows.
    """
    marked = cut(fingerprints(docs))
    of_fp = cut(roots_of(marked, max_bits, tile).select("fp", "component_id"))
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
