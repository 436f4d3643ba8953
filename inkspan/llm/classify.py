"""What the two document classifiers share: a bounded labelled sample, one training task, scoring of every whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCORES = "doc_id long, score double, predicted int"
#: Characters of texts that are featurised at once, at most, unless one text is longer.
SLICE_CHARS = 1_000_000
#: Characters of the texts of a labelled sample, at most: a row that would exceed it is not learnt from.
SAMPLE_CHARS = 256_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int) -> DataFrame:
    """doc_id, text and label of ``rows`` labelled documents at most: those with the least hashes of their ids.

    ``learn_from`` is a predicate on doc_id. Rows without a label or an id are not learnt from; an id with several labels
    has their least, one with several texts their least text. The ids are bounded by ``rows``, so they are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(learn_from).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    held = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.join(docs.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(sample: DataFrame, fit: Callable[[list[str], list[int]], bytes], chars: int = SAMPLE_CHARS) -> bytes:
    """Fit on the bounded sample, in the order of the ids' hashes, in one task; the compact weights come to the driver.

    The sample is bounded by its rows and by ``chars``, so that very long texts cannot fill the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, held = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held + len(text) <= chars:
                    texts.append(text)
                    labels.append(label)
                    held += len(text)
        yield pa.RecordBatch.from_pydict({"model": [fit(texts, labels)]}, schema=pa.schema([("model", pa.binary())]))

    small_batches(sample.sparkSession)
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")
    found = ordered.mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else fit([], [])  # an empty sample is no task


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > chars:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def score_rows(docs: DataFrame, scorer: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    """All rows and columns of ``docs``, with score and predicted; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at, names = kept.index("text"), [*kept, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = np.concatenate([scorer(part) for part in slices(texts)]) if texts else np.zeros(0)
            extra = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return source.mapInArrow(run, schema)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
