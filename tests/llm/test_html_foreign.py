"""Heads without an end tag, and svg and math: visible text stays, hidden text goes."""

import pytest

from inkspan.llm import html_text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>T</title><body><p>text", "text"),
        ("<html><head><title>T</title><p>text", "text"),
        ("<head><meta charset=x><style>s</style>\n text", "text"),
        ("<head><title>T</title></body>text", "text"),
        ("<head><template><p>no</p></template><title>T</title></head><p>a<head>b", "ab"),
        ("<p>a <svg viewBox='0 0 1 1'/> b", "a b"),
        ("<p>a <math/> b", "a b"),
        ("<div>a<svg><path d='M0'/><g><circle r=1 /></g></svg>b</div>c", "ab\nc"),
        ("<p>let <math>\n <mi>x</mi>\n <mo>=</mo>\n <mfrac><mn>1</mn><mn>2</mn></mfrac></math> be", "let x= 1 2 be"),
        ("<math><semantics><mi>x</mi><annotation>no</annotation><annotation-xml><p>no</p></annotation-xml></semantics></math>y", "xy"),
        ("<svg>no<title>no</title><desc>no</desc><defs><text>no</text></defs><text x=1>a <tspan>b</tspan></text><text>c</text></svg>d", "a b\nc\nd"),
        ("<svg><text display=none>no</text><text style='display:none'>no</text></svg>a", "a"),
        ("<svg hidden><text>no</text></svg><p hidden><svg><text>no</text></svg></p>a", "a"),
        ("<p>a<svg><foreignObject><div>b</div></foreignObject></svg>c", "a\nb\nc"),
        ("<svg><g><p>out", "out"),
        ("<svg><title/><style/><text>a</text></svg>b", "a\nb"),
        ("<svg><td>x</td><tr><li>a", "- a"),
        ("<div><svg><g></div>a", "a"),
        ("<math><mtext><![CDATA[a &lt; b]]></mtext></math>", "a &lt; b"),
        ("<math><![CDATA[a > b]]></math>c", "a > bc"),
        ("<math><mi>x</math>y", "xy"),
        ("<table><tr><td><svg/>a<td><math><mi>b</mi></math></table>", "a | b"),
        ("<div><svg>" * 3000 + "<text>deep", "deep"),
    ],
)
def test_rendering(source, text):
    assert html_text.visible_text(source) == text
