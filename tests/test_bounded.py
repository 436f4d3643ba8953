"""Bounded reads: files and collections within, at and beyond the limit, by hand."""

import os

import pytest

from inkspan.sources import bounded


def test_limits_of_files_and_collections(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    a, at, over, wide, bad, empty = put("a", "x" * 60), put("at", "é" * 100), put("over", "x" * 101), put("wide", "😀" * 100), put("bad", b"\xff\xfe"), put("empty", "")
    huge = str(tmp_path / "huge")
    with open(huge, "wb") as f:
        os.truncate(f.fileno(), 2 * 1024**3)
    collections = {"one": [a, empty], "at": [at], "wide": [wide], "over": [over, a], "sum": [a, a, a], "huge": [huge], "odd": [bad, str(tmp_path / "none"), a], "uri": [f"file://{a}"], "none": []}
    told = {}
    for r in bounded.bounded_texts(spark, collections, 100).collect():
        told.setdefault(r.collection, []).append((r.n_chars, r.reason))
        assert (r.text is None) == (r.reason is not None) and (r.text is None or len(r.text) == r.n_chars)
    assert told == {
        "one": [(60, None), (0, None)],
        "at": [(100, None)],
        "wide": [(100, None)],
        "over": [(None, "too long"), (None, "collection too long")],
        "sum": [(60, None), (60, "collection too long"), (None, "collection too long")],
        "huge": [(None, "too long")],
        "odd": [(None, "not UTF-8"), (None, "missing"), (60, None)],
        "uri": [(60, None)],
    }


def test_names_with_tabs_are_refused(spark):
    with pytest.raises(ValueError):
        bounded.bounded_texts(spark, {"a": ["x\ty"]})
