"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import connected_components
from .simhash import spanning_links

THRESHOLD = 0.95
TABLES, ROUNDS, SEED = 12, 3, 11
#: A bucket is compared in tiles of about this many vectors, each pair of tiles a group of its own.
TILE = 512
#: Rows that one call of Python compares, about; groups are dealt over as many lots.
LOT_ROWS = 2048
#: Parts that the name of a component is told in.
SALTS = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width, step = *x.shape, 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def functions_for(vectors: int, width: int) -> int:
    """Hash functions of a table: as many as give about as many buckets as there are vectors."""
    return max(1, math.ceil(math.log(max(2, vectors)) / math.log(2 * width)))


def bucket_keys(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """Keys of each row's buckets: per table the nearest polytope corners, and for each function its second-nearest in their place."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    random, out, rows = np.random.default_rng((SEED, width)), [], np.arange(n)
    with np.errstate(over="ignore"):
        for t in range(tables):
            best, second = [], []
            for _ in range(functions):
                y = padded
                for _ in range(ROUNDS):
                    y = hadamard(y * random.choice([-1.0, 1.0], width)) / math.sqrt(width)
                top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
                top = np.where((np.abs(y[rows, top[:, 0]]) >= np.abs(y[rows, top[:, 1]]))[:, None], top, top[:, ::-1])
                corner = lambda i, y=y: (2 * i + (y[rows, i] < 0)).astype(np.uint64)
                best.append(corner(top[:, 0]))
                second.append(corner(top[:, 1]))
            for probe in range(-1, functions):
                key = np.full(n, (dim << 16) + t, np.uint64)
                for j in range(functions):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + (second if j == probe else best)[j] + np.uint64(1)
                    key ^= key >> np.uint64(31)
                out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def hashed(classes: DataFrame, tables: int, functions: int) -> DataFrame:
    """(rep, keys) of each class of equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, vectors, keys = batch.column(0), batch.column(1), [None] * batch.num_rows
            lengths = np.diff(vectors.offsets.to_numpy())
            values, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                rows = values[starts[at][:, None] + np.arange(dim)]
                for i, own in zip(at, bucket_keys(rows / np.abs(rows).max(axis=1, keepdims=True), tables, functions), strict=True):
                    keys[i] = np.unique(own)
            yield pa.RecordBatch.from_arrays([reps, pa.array(keys, pa.list_(pa.int64()))], names=["rep", "keys"])

    return classes.select("rep", "embedding").mapInArrow(run, "rep long, keys array<long>")


def _unit(vectors) -> np.ndarray:
    v = np.stack(vectors).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _small_groups(pdf, group: np.ndarray, threshold: float) -> list[tuple]:
    """Pairs of groups of few rows, found for all groups at once by comparing each row with the next, the next but one, ..."""
    out, keys = [], pdf["keys"].to_numpy()
    reps, mult, own, key, tile_i, tile_j = (pdf[c].to_numpy() for c in ("rep", "mult", "own", "key", "i", "j"))
    v = _unit(pdf["embedding"].to_numpy())
    for ahead in range(1, int(np.bincount(group).max(initial=0))):
        a = np.flatnonzero(group[ahead:] == group[:-ahead])
        a = a[(tile_i[a] == tile_j[a]) | (own[a] != own[a + ahead])]
        a = a[np.einsum("ij,ij->i", v[a], v[a + ahead]) >= threshold]
        for x in a.tolist():
            y = x + ahead
            counts = np.intersect1d(keys[x], keys[y], assume_unique=True)[0] == key[x]
            root = min(reps[x], reps[y])
            out += [(reps[x], mult[y] * counts, root), (reps[y], mult[x] * counts, root)]
    return out


def _large_group(pdf, threshold: float):
    """Rows of one group with the weight of their partners, by a product of matrices, and a spanning forest."""
    key, i, j = int(pdf["key"].iat[0]), int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
    reps, own, mult = pdf["rep"].to_numpy(), pdf["own"].to_numpy(), pdf["mult"].to_numpy()
    v = _unit(pdf["embedding"].to_numpy())
    close = v @ v.T >= threshold
    np.fill_diagonal(close, False)
    if i != j:
        close &= own[:, None] != own[None, :]
    a, b = spanning_links(np.arange(len(pdf)), lambda rows: close[rows])
    root = np.arange(len(pdf))
    root[a] = b
    earlier = pdf["keys"].map(lambda k: k[k < key])
    flat, of = np.concatenate(earlier.to_numpy()), np.repeat(np.arange(len(pdf)), earlier.map(len).to_numpy())
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    two = count[column] > 1
    if two.any():
        columns, column = np.unique(column[two], return_inverse=True)
        held = np.zeros((len(pdf), len(columns)), np.float32)
        held[of[two], column] = 1
        close &= held @ held.T == 0
    return zip(reps.tolist(), (close @ mult).tolist(), reps[root].tolist(), strict=True)


def compare_tiles(placed: DataFrame, threshold: float, lots: int, small: int = 24) -> DataFrame:
    """Verified pairs of each pair of tiles (key, i, j), as counts and links that connect them: (rep, links, root).

    A pair that meets in several buckets is counted in the one of the least key. Groups are dealt over ``lots``, so that
    a call of Python has some thousands of rows, whatever the groups' sizes.
    """

    def compare(pdf):
        import pandas as pd

        out: list[tuple] = []
        for _, same in pdf.groupby(pdf["embedding"].map(len)):
            rows = same.sort_values(["key", "i", "j", "rep"], ignore_index=True)
            group = rows.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
            few = np.bincount(group)[group] <= small
            if few.any():
                out += _small_groups(rows[few], group[few], threshold)
            for _, large in rows[~few].groupby(group[~few]):
                out += _large_group(large, threshold)
        return pd.DataFrame(out, columns=["rep", "links", "root"])

    return placed.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(lots)).alias("lot")).applyInPandas(compare, "rep long, links long, root long")


def links_of(classes: DataFrame, threshold: float, tables: int, tile: int) -> DataFrame:
    """(rep, links, root) rows over all buckets; classes: rep, embedding, mult."""
    n, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    marked = cut(hashed(classes, tables, functions_for(n, 1 << max(1, (width - 1).bit_length()))))
    entries = marked.select("rep", F.explode("keys").alias("key"))
    # Of buckets with the same members one is enough
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(38,0)")).alias("s")).where("n > 1")
    chosen = full.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n")
    held = cut(entries.join(chosen, "key"))
    keys = held.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    tiled = held.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = tiled.join(classes.drop("least").join(keys, "rep"), "rep").select("key", "i", "j", "own", "rep", "mult", "keys", "embedding")
    replicas = held.agg(F.coalesce(F.sum(F.ceil(F.col("n") / tile)), F.lit(0))).first()[0]
    return compare_tiles(placed, threshold, max(1, int(replicas) // LOT_ROWS))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Vectors are linked if their cosine, in double precision, is ``threshold`` or more; only verified pairs link. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of unequal length;
    a row without a vec_id links with nothing, its component is null and it is not kept. Equal vectors are one class,
    whatever their number, and count as links of each other; repeated rows count each. Rows of one id on different vectors
    are each linked by their own vector, and kept where that is the least id of its component. A vector has as many numbers
    as it has, however many. No rows give no rows. Large buckets are compared tile by tile, with no cap.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(good)
    # A class has a number of its own, fixed by being written; its least id may stand on other vectors too
    classes = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult")).withColumn("rep", F.monotonically_increasing_id()))
    found = cut(links_of(classes, threshold, tables, tile))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = cut(classes.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1))
    # The least id of a component is told to its classes in SALTS parts, so that a large one is no single task's
    dealt = told.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    names = dealt.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = told.where("component is null").select("embedding", "n_links", F.col("least").alias("component_id")).unionAll(dealt.join(names, ["component", "salt"]).select("embedding", "n_links", "component_id"))
    linked = valid.join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
