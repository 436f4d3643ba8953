"""Texts made to clash in the first 64 bits, and edited texts that clash."""

import random

from pyspark.sql import functions as F

from inkspan.llm import fingerprint

DOCS = "doc_id long, text string"
FULL, P1, P2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789!#$%&'()*+,-./:;<=>?@[]^_{|}~"


def clash():
    """Two texts of 64 bytes whose first lanes differ and whose second lanes make up for it, by XXH64 with the seed of 42."""
    rng = random.Random(1)

    def after(lane):
        v = (42 + P1 + P2 + int.from_bytes(lane, "little") * P2) & FULL
        return ((v << 31 | v >> 33) & FULL) * P1 & FULL

    while True:
        a, b = (bytes(rng.choices(LETTERS, k=8)) for _ in "ab")
        d = (after(a) - after(b)) * pow(P2, -1, 1 << 64) & FULL
        first, second, carry = [], [], 0
        for k in range(8):
            # (x + byte of d + carry) is the other text's byte
            step = (d >> 8 * k & 255) + carry
            x = next((x for x in LETTERS if (x + step) & 255 in LETTERS), None)
            if x is None:
                break
            first.append(x)
            second.append((x + step) & 255)
            carry = (x + step) >> 8
        else:
            fill = b"q" * 24
            return tuple((lane + fill + bytes(other) + fill).decode() for lane, other in ((a, first), (b, second)))


def test_halves_are_independent(spark):
    a, b = clash()
    rows = spark.createDataFrame([(1, a), (2, b)], DOCS).select(F.xxhash64("text").alias("first"), fingerprint.wide_hash(F.col("text")).alias("wide")).collect()
    assert a != b and rows[0].first == rows[1].first
    assert rows[0].wide[:16] == rows[1].wide[:16] and rows[0].wide[16:] != rows[1].wide[16:]


def test_edited_texts_that_clash_are_told_apart(spark, monkeypatch):
    """All hashes clash: no two texts that differ have one fingerprint, be they edited or not."""
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lpad(F.length(c).cast("string"), 32, "0"))
    texts = ["abcd", "efgh", "ijkl", "abcd", "xyz"]
    rows = fingerprint.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    found = {}
    for r in rows:
        x, y = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        for text, mark in ((x, r.fingerprint), (x[: len(x) - len(x) // 2] + y[: len(x) // 2], r.edited_fingerprint)):
            assert found.setdefault(text, mark) == mark
    assert len(set(found.values())) == len(found)
