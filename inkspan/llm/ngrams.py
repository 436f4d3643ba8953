"""Hashed n-grams of whole texts, computed on arrays of code points for a batch of texts at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Odd multipliers of the polynomial and mixing hashes (wrapping 64-bit arithmetic).
_BASE, _MIX, _PAIR, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@cache
def _not_space() -> np.ndarray:
    return np.fromiter((not chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line end after each, and where each text ends."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "\n".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths)


def _words(codes: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of each run of characters that are ``inside``."""
    mask = inside[codes]
    start = np.flatnonzero(mask & ~np.concatenate([[False], mask[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start
    at = np.arange(len(codes))
    at -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(codes)]])))
    terms = np.where(mask, (codes + np.uint32(1)).astype(np.uint64) * _powers(1 << 16)[at & 0xFFFF], np.uint64(0))
    return _mixed(np.add.reduceat(terms, start)), np.searchsorted(ends, start, side="right"), start


def word_features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of word 1-, 2- and 3-grams and of skip-grams over one and two words. Words are lower-cased
    runs of letters and digits; ``buckets`` is a power of two."""
    codes, ends = _codes([t.lower() for t in texts])
    h, doc, _ = _words(codes, ends, _alphanumeric())
    found = [(doc, h)]
    for gap, factor in ((1, _PAIR), (2, _SKIP), (3, np.uint64(0x27D4EB2F165667C5))):
        same = doc[gap:] == doc[:-gap]
        found.append((doc[gap:][same], _mixed(h[:-gap] * factor + h[gap:])[same]))
    same = doc[2:] == doc[:-2]
    found.append((doc[2:][same], _mixed(_mixed(h[:-2] * _PAIR + h[1:-1]) * _PAIR + h[2:])[same]))
    return np.concatenate([d for d, _ in found]), (np.concatenate([x for _, x in found]) >> np.uint64(20)).astype(np.int64) & (buckets - 1)


def distinct_features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``word_features``, each once per document, ordered by document."""
    doc, bucket = word_features(texts, buckets)
    pairs = np.unique(doc * buckets + bucket)
    return pairs // buckets, pairs % buckets


def subword_features(texts: list[str], buckets: int, sizes: tuple[int, ...] = (2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket), repeats included, of words, of character n-grams inside words with their ends, and of word
    2-grams in relative form: a word that repeats the last or the last but one has a bucket of its own."""
    codes, ends = _codes(texts)
    h, doc, start = _words(codes, ends, _not_space())
    found = [(doc, h)]
    for gap in (1, 2):
        again = (doc[gap:] == doc[:-gap]) & (h[gap:] == h[:-gap])
        found.append((doc[gap:][again], np.full(int(again.sum()), np.uint64(gap) << np.uint64(20))))
    if len(start):
        inside = _not_space()[codes]
        of_text = np.searchsorted(ends, np.arange(len(codes)), side="right") if len(ends) < 2 else np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        # A space counts as the end of the word before it and the start of the next
        marked = np.where(inside, codes, np.uint32(32)).astype(np.uint64) + np.uint64(1)
        for n in sizes:
            last = len(codes) - n + 1
            if last <= 0:
                continue
            gram, whole = np.zeros(last, np.uint64), np.ones(last, bool)
            for i in range(n):
                gram = gram * _BASE + marked[i : i + last]
                if 0 < i < n - 1:
                    whole &= inside[i : i + last]
            if n == 2:
                whole = inside[:last] | inside[1 : last + 1]
            else:
                whole &= of_text[:last] == of_text[n - 1 :]
            found.append((of_text[:last][whole], _mixed(gram * _SKIP + np.uint64(n))[whole]))
    return np.concatenate([d for d, _ in found]), (np.concatenate([x for _, x in found]) >> np.uint64(20)).astype(np.int64) & (buckets - 1)
