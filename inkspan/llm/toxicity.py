"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import labelled_sample, logistic, score_rows, slices, train
from .common import crc_bucket, table
from .ngrams import distinct_features

#: Bound of the labelled sample that the weights are learnt from.
SAMPLE_ROWS = 16_000
BUCKETS = 1 << 20
THRESHOLD = 0.3
EPOCHS = 3
#: Per-coordinate rates alpha / (beta + root of summed squared gradients), and the two penalties.
ALPHA, BETA, L1, L2 = 0.7, 1.0, 6.0, 0.1


def ftrl(rows: list[np.ndarray], labels: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of distinct active features: the non-zero weights' places, the weights, the bias."""
    z, n = np.zeros(buckets), np.zeros(buckets)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for active, y in zip(rows, labels, strict=True):
            za, na = z[active], n[active]
            w = weight(za, na)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = float(logistic(np.array(w.sum() + bias))) - y
            root = np.sqrt(na + g * g)
            z[active] = za + g - (root - np.sqrt(na)) / ALPHA * w
            n[active] = na + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    w = weight(z, n)
    places = np.flatnonzero(w)
    return places, w[places], -bias_z / ((BETA + bias_n**0.5) / ALPHA)


def fit(texts: list[str], labels: list[int]) -> bytes:
    rows: list[np.ndarray] = []
    for part in slices(texts):
        doc, bucket = distinct_features(part, BUCKETS)
        rows += np.split(bucket.astype(np.int32), np.searchsorted(doc, np.arange(1, len(part))))
    places, weights, bias = ftrl(rows, labels)
    return np.float64(bias).tobytes() + np.uint32(len(places)).tobytes() + places.astype("<u4").tobytes() + weights.astype("<f4").tobytes()


class Scorer:
    """Scores by the compact weights; a text of no words has the bias alone."""

    def __init__(self, model: bytes):
        self.model, self.weights = model, None

    def __getstate__(self):
        return {"model": self.model, "weights": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            k = int(np.frombuffer(self.model, "<u4", 1, 8)[0])
            self.weights = np.zeros(BUCKETS)
            self.weights[np.frombuffer(self.model, "<u4", k, 12)] = np.frombuffer(self.model, "<f4", k, 12 + 4 * k)
            self.bias = float(np.frombuffer(self.model, "<f8", 1)[0])
        doc, bucket = scored_features(texts, self.weights)
        return logistic(np.bincount(doc, self.weights[bucket], len(texts)) + self.bias)


def scored_features(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document that have a weight: few are left, so only they are made distinct."""
    from .ngrams import word_features

    doc, bucket = word_features(texts, len(weights))
    live = weights[bucket] != 0
    pairs = np.unique(doc[live] * len(weights) + bucket[live])
    return pairs // len(weights), pairs % len(weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with score and predicted, by weights learnt from ``labels`` where ``learn_from``.

    A null text is the empty text; empty texts get the bias's score; repeated rows get equal scores; with no labelled
    row the score is 0.5 everywhere; no documents give no rows. The sample is bounded by ``sample_rows``; the weights are
    at most as many as hash buckets and are sent with the task. Whole texts of any length are scored.
    """
    model = train(labelled_sample(docs, labels, "toxic", learn_from, sample_rows), fit)
    return score_rows(docs, Scorer(model), threshold)


def learnt_rows() -> Column:
    return crc_bucket("doc_id", 4) != 2


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learnt_rows())
    return scored.select("doc_id", F.coalesce(~learnt_rows(), F.lit(False)).alias("held_out"), "score", "predicted")
