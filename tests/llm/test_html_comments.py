"""Ends of comments, deep stacks, wide cells, numbered items and dialogs."""

import random
import re
import time

import pytest

from inkspan.llm.html_text import visible_text

CASES = {
    "<p>a<!-->b</p><p>c</p>": "ab\n\nc",
    "<p>a<!--->b</p>": "ab",
    "<p>a<!-- x --!>b</p><p>c": "ab\n\nc",
    "<p>a<!---->b": "ab",
    "<p>a<!-- > -> -- ! -->b": "ab",
    "<p>a<!-- x": "a",
    "<p>a<!-- <!-- x --> b --> c": "a b --> c",
    "<p>a<!--->b<!-- c -->d": "abd",
    "<ol><li>a<li value=7>b<li>c<li value=x>d</ol>": "1. a\n7. b\n8. c\n9. d",
    "a<dialog>b</dialog>c": "ac",
    "a<dialog open>b</dialog>c": "a\nb\nc",
    "<table><tr><td>a<td colspan=1000><td>b<tr><td>c<td colspan=1000><td>d</table>": "a | b\nc | d",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert visible_text(page) == CASES[page]


def slow_uncommented(page):
    """A page without its comments, by the states of the standard's tokenizer."""
    out, i = [], 0
    while i < len(page):
        if not page.startswith("<!--", i):
            out.append(page[i])
            i += 1
            continue
        i += 4
        if page.startswith(">", i) or page.startswith("->", i):
            i = page.index(">", i) + 1
            continue
        while i < len(page) and not (page.startswith("-->", i) or page.startswith("--!>", i)):
            i += 1
        i = page.index(">", i) + 1 if i < len(page) else i
    return "".join(out)


def test_generated_comments():
    rng = random.Random(8)
    parts = ["<!--", "-->", "--!>", "->", ">", "-", "--", "!", "w", "x y", "<b>", "</b>"]
    for _ in range(5000):
        page = "<p>" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert visible_text(page) == visible_text(slow_uncommented(page)), page


@pytest.mark.parametrize("tags", ["<b>|</i>", "<i><table><td>|<b>|</i>", "<svg>|<g>|</x>", "<div>|</section>", "<ul>|<p>|</li>"])
def test_unmatched_end_tags_take_linear_time(tags):
    """About 1 MB of tags that end nothing."""
    *opened, unmatched = tags.split("|")
    n = 1_000_000 // len(opened[-1] + unmatched)
    page = "".join(opened[:-1]) + opened[-1] * n + unmatched * n + "seen"
    start = time.time()
    text = visible_text(page)
    assert time.time() - start < 20
    assert "seen" in text or re.search("svg", tags)
