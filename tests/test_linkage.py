"""Links between neighbouring paragraphs on rows made for them, odd ones among them."""

import pytest

from inkspan.operators import linkage

A = "Copper kettles whistle above orange flames while painters sketch harbours"
B = "Distant glaciers grind granite ridges beneath silent northern constellations"
C = "Bakers knead warm dough before sunrise hums along narrow cobbled streets"


@pytest.fixture(scope="module")
def told(spark):
    def run(name, *texts):
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start_pos string")
        return sorted(tuple(r) for r in getattr(linkage, name)(docs).collect())

    return run


def test_reshuffle(told):
    free = f"{A}\n\n{B}\n\n{C}"
    rows = [
        free,
        f"{A}\n\n{B}\n\nHowever {C}",
        f"{A}\n\n# Part\n\n{B}\n\n{C}",
        f"{A} `x`\n\n{B}\n\n{C}",
        f"{A}\n\n{B}\n\n{B}",
        f"\n{A}\n\n{B}\n\n{C}",
        f"🚀 short\n\n- item\n\n{free}\n\n{A}",
        f"{A}\n\n{B}\n\nThere {C}",
        None,
        "",
        "\n\n\n",
    ]
    offset = len("🚀 short\n\n- item\n\n")
    assert told("paragraph_reshuffle", *rows) == [(0, 0, len(free)), (6, offset, offset + len(free)), (7, 0, len(free) + 6)]


def test_treadmill(told):
    start = len(A) + 2
    rows = [f"{A}\n\n{A} again.\n", f"{A}\n\n> {A}\n\n{B}", f"{A}\n\n{B}", f"\n\n{A}\n\n\n\n{A}", None, "", "one\n\ntwo"]
    n = len(set(A.lower().split()))
    got = told("treadmill_prose", *rows)
    assert [g[:3] for g in got] == [(0, start, start + len(A) + 8), (3, start + 4, start + 4 + len(A))]
    assert all(g[4] == 1.0 and g[3] == n for g in got)
    assert told("treadmill_prose", rows[0], rows[0])[0][1:] == told("treadmill_prose", rows[0], rows[0])[1][1:]


def test_no_rows(told):
    for name in ("treadmill_prose", "paragraph_reshuffle"):
        assert told(name) == []
