"""Quality by supervised subword embeddings: averaged vectors of hashed words and character n-grams under a softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import labelled_sample, logistic, score_rows, slices, train
from .common import crc_bucket, table
from .ngrams import subword_features

#: Bound of the labelled sample that the vectors are learnt from.
SAMPLE_ROWS = 6_000
BUCKETS, DIM = 1 << 17, 8
THRESHOLD = 0.3
EPOCHS, RATE, SEED = 4, 0.8, 7


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent on rows of (features, shares that sum to 1): vectors, output weights, output bias."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps = max(1, epochs * len(rows))
    for step in range(epochs * len(rows)):
        i = step % len(rows)
        features, share = rows[i]
        own = vectors[features]
        mean = share @ own
        scores = mean @ out + bias
        p = np.exp(scores - scores.max())
        p /= p.sum()
        p[labels[i]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        back = out @ p
        out -= rate * np.outer(mean, p)
        bias -= rate * np.float32(0.1) * p
        # Shares are small, so a vector's step is scaled up to the size that a few features of equal share would take
        vectors[features] = own - rate * np.outer(np.minimum(share * 50, 1), back)
    return vectors, out, bias


def fit(texts: list[str], labels: list[int]) -> bytes:
    rows = []
    for part in slices(texts):
        doc, bucket = subword_features(part, BUCKETS)
        pairs, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(1, len(part)) * BUCKETS)
        for features, count in zip(np.split((pairs % BUCKETS).astype(np.int32), cuts), np.split(counts, cuts), strict=True):
            rows.append((features, (count / max(1, count.sum())).astype(np.float32)))
    vectors, out, bias = sgd(rows, labels)
    return bias.tobytes() + out.tobytes() + vectors.tobytes()


class Scorer:
    """P(label 1): the softmax of two outputs of the mean vector, that is the logistic function of the mean of each
    feature's share of their difference. A text without features has the bias alone."""

    def __init__(self, model: bytes):
        bias, out = np.frombuffer(model, "<f4", 2), np.frombuffer(model, "<f4", 2 * DIM, 8).reshape(DIM, 2)
        vectors = np.frombuffer(model, "<f4", -1, 8 + 8 * DIM).reshape(-1, DIM)
        self.bias, self.share = float(bias[1] - bias[0]), vectors @ (out[:, 1] - out[:, 0])

    def __call__(self, texts: list[str]) -> np.ndarray:
        doc, bucket = subword_features(texts, len(self.share))
        sums, n = np.bincount(doc, self.share[bucket], len(texts)), np.bincount(doc, minlength=len(texts))
        return logistic(sums / np.maximum(n, 1) + self.bias)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with score and predicted, by a model learnt from ``labels`` where ``learn_from``.

    A null text is the empty text; empty texts get the bias's score; repeated rows get equal scores; with no labelled row
    the score is 0.5 everywhere; no documents give no rows. The sample is bounded by ``sample_rows``; the model's size is
    fixed by its number of buckets. Whole texts of any length are scored.
    """
    model = train(labelled_sample(docs, labels, "quality", learn_from, sample_rows), fit)
    return score_rows(docs, Scorer(model), threshold)


def learnt_rows() -> Column:
    return crc_bucket("doc_id", 5) != 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learnt_rows())
    return scored.select("doc_id", F.coalesce(~learnt_rows(), F.lit(False)).alias("held_out"), "score", "predicted")
