"""Generated pages: a tree whose visible words are known is written as HTML, with odd attributes and optional tags left out."""

import random
from collections import Counter

import pytest

from inkspan.llm.html_text import visible_text

ATTRIBUTES = ["", "", "", " class=a", " title=it's", ' "', " '", ' title="a > b"', " title='<p>'", ' data-x = "y"', " a=b'c\"d", " =q", "\n\tid=1 ", ' title="', " /"]
ATTRIBUTES.remove(' title="')  # an open quote takes the rest of the page with it, as the standard has it
HIDDEN = [" hidden", ' style="display:none"', " style=display:none", ' hidden="" class="x"']


class Pages:
    def __init__(self, seed):
        self.random, self.n, self.want = random.Random(seed), 0, []

    def words(self, seen):
        out = []
        for _ in range(self.random.randint(1, 3)):
            self.n += 1
            out.append(f"w{self.n}")
        if seen:
            self.want += out
        return " ".join(out)

    def odd(self):
        return self.random.choice(ATTRIBUTES)

    def inline(self, seen, depth=0):
        out = []
        for _ in range(self.random.randint(1, 3)):
            kind = self.random.random()
            if kind < 0.5 or depth > 2:
                out.append(self.words(seen))
            elif kind < 0.75:
                tag = self.random.choice(["b", "i", "span", "em", "a"])
                out.append(f"<{tag}{self.odd()}>{self.inline(seen, depth + 1)}</{tag}>")
            elif kind < 0.82:
                out.append(f"<span{self.random.choice(HIDDEN)}>{self.inline(False, depth + 1)}</span>")
            elif kind < 0.88:
                # What is invisible may hold what is visible, unless it is not shown at all
                hidden = self.words(False)
                out.append(f'<span style="visibility: hidden">{hidden} <b style="visibility:visible">{self.words(seen)}</b></span>')
            else:
                out.append(self.random.choice(["<!-- c > -->", "<br>", "<img alt='x'>", "<script>if (a < b) x('</p>')</script>", "<style>p { }</style>"]))
        return " ".join(out)

    def close(self, tag, may_drop):
        return "" if may_drop and self.random.random() < 0.5 else f"</{tag}>"

    def blocks(self, seen, depth=0):
        kinds = [self.random.choice(["p", "p", "div", "ul", "ol", "dl", "table", "h2", "blockquote", "hidden", "hr"]) for _ in range(self.random.randint(1, 3))]
        if depth > 2:
            kinds = ["p"] * len(kinds)
        out = []
        for kind in kinds:
            if kind == "p":
                # Every sibling here is a block that ends a paragraph, and so does the parent's end
                out.append(f"<p{self.odd()}>{self.inline(seen)}{self.close('p', True)}")
            elif kind in ("div", "blockquote"):
                out.append(f"<{kind}{self.odd()}>{self.blocks(seen, depth + 1)}</{kind}>")
            elif kind in ("ul", "ol"):
                items = [f"<li{self.odd()}>{self.inline(seen) if self.random.random() < 0.6 else self.blocks(seen, depth + 1)}{self.close('li', True)}" for _ in range(self.random.randint(1, 3))]
                out.append(f"<{kind}>{' '.join(items)}</{kind}>")
            elif kind == "dl":
                items = [f"<dt>{self.inline(seen)}{self.close('dt', True)}<dd>{self.inline(seen)}{self.close('dd', True)}" for _ in range(2)]
                out.append(f"<dl>{''.join(items)}</dl>")
            elif kind == "table":
                out.append(self.table(seen, depth))
            elif kind == "h2":
                out.append(f"<h2>{self.inline(seen)}</h2>")
            elif kind == "hidden":
                out.append(f"<div{self.random.choice(HIDDEN)}>{self.blocks(False, depth + 1)}</div>")
            else:
                out.append("<hr>")
        return "\n".join(out)

    def table(self, seen, depth):
        rows = []
        for _ in range(self.random.randint(1, 3)):
            cells = [f"<td{self.random.choice(['', ' rowspan=2', ' colspan=2', ' rowspan=0', ''])}>{self.inline(seen) if self.random.random() < 0.7 else self.blocks(seen, depth + 1)}{self.close('td', True)}" for _ in range(self.random.randint(1, 3))]
            rows.append(f"<tr>{''.join(cells)}{self.close('tr', True)}")
        body = self.random.random() < 0.5
        return f"<table>{'<tbody>' * body}{''.join(rows)}{self.close('tbody', True) * body}</table>"

    def page(self):
        head = f"<title{self.odd()}>{self.words(False)}</title>" + self.random.choice(["", "<meta charset=utf-8>", "<style>a > b { }</style>", "<script>'<body>'</script>"])
        parts = [self.random.choice(["<!doctype html>", ""]), self.random.choice(["<html>", ""]), self.random.choice(["<head>", ""]), head, self.random.choice(["</head>", ""]), self.random.choice(["<body>", "<body class=x>", ""])]
        return "".join(parts) + self.blocks(True) + self.random.choice(["</body></html>", "</body>", "", "<a href='x", "<p title=\"x"])


@pytest.mark.parametrize("block", range(8))
def test_visible_words_of_generated_pages(block):
    for seed in range(50 * block, 50 * block + 50):
        made = Pages(seed)
        source = made.page()
        got = [x for x in visible_text(source).split() if x[0] == "w"]
        assert Counter(got) == Counter(made.want), source
        if "<table" not in source:
            assert got == made.want, source


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>T</title><body><p>Hello world", "Hello world"),
        ("<a title=it's>Hello</a> world", "Hello world"),
        ('<p ">text</p> more', "text\n\nmore"),
        ("text <a href='x", "text"),
        ('<div style="visibility:hidden">a<b style="visibility:visible">b</b></div>c', "b\nc"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<p a=1 a=2 hidden>x</p>y", "y"),
    ],
)
def test_layout_by_hand(source, text):
    assert visible_text(source) == text


def test_very_long_page_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from inkspan.llm.html_text import extract_text

    pages = spark.createDataFrame([(1, "<p>x " * 200_000), (1, None), (None, "")], "page_id long, html string").withColumns({"text": F.lit("other"), "n_chars": F.lit(0)})
    got = sorted(((r.page_id, len(r.text)) for r in extract_text(pages).collect()), key=str)
    assert got == [(1, 0), (1, 3 * 200_000 - 2), (None, 0)]
