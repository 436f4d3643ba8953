"""Regions, technical spans and Chinese findings: cases written by hand, and slow counterparts on generated texts."""

import random
import re

import pytest

from inkspan.operators import fidelity, locale

REGIONS = [
    ("    a = 1\n    b = 2\nend", {("indented_code", 0, 19)}),
    ("| a | b |\n|---|---|\n| c | d |\nx", {("table", 0, 29)}),
    ("a\n---\nb", {("table", 2, 5)}),
    ("> one\n> two\nthree", {("blockquote", 0, 11)}),
    ("$ ls -l\n$ pwd\n$x", {("command", 0, 13)}),
    ("# Title\n## Sub", {("heading", 0, 7), ("heading", 8, 14)}),
    ("```json\n{}\n```", {("json_block", 0, 14)}),
    ("```yml\na\n```", {("yaml_block", 0, 12)}),
    ("```\na\n```", {("code_block", 0, 9)}),
    ("see [a b](http://x.y/z) now", {("markdown_link", 4, 23)}),
    ("in 45% of `cases`", {("number", 3, 6), ("quoted", 10, 17)}),
    ("# 45 ways", {("heading", 0, 9)}),
    ("plain words", set()),
    ("", set()),
    (None, set()),
]
TECHNICAL = [
    ("call os.path now", {("api_name", 5, 12)}),
    ("use snake_case and camelCase or run (x)", {("api_name", 4, 14), ("api_name", 19, 28), ("api_name", 32, 37)}),
    ("see #tag, @user, <b>", {("tag", 4, 8), ("tag", 10, 15), ("tag", 17, 20)}),
    ("plain words", set()),
]
ZH = [
    ("这是好的,对吗", {("zh-cn-punct-width", 3, 5)}),
    ("使用Spark处理", {("zh-cn-spacing", 1, 3), ("zh-cn-spacing", 6, 8)}),
    ("他被大家所喜爱", {("zh-cn-translationese", 1, 5)}),
    ("我们进行了测试", {("zh-cn-translationese", 2, 5)}),
    ("在开发的过程中出错", {("zh-cn-translationese", 0, 7)}),
    ("这一现象很多", {("zh-cn-translationese", 0, 4)}),
    ("看`中,文`吧", set()),
    ("这是好的。", set()),
    ("A long English line with one 字,only here and nothing more", set()),
    ("", set()),
    (None, set()),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")


@pytest.mark.parametrize("cases, operator", [(REGIONS, locale.repair_regions), (TECHNICAL, locale.technical_spans)])
def test_spans(spark, cases, operator):
    found = operator(frame(spark, cases)).collect()
    for i, (text, want) in enumerate(cases):
        assert {(r.category, r.start_pos, r.end_pos) for r in found if r.doc_id == i} == want, text


def test_chinese_findings(spark):
    found = locale.zh_cn_findings(frame(spark, ZH)).collect()
    for i, (text, want) in enumerate(ZH):
        assert {(r.rule_id, r.start_pos, r.end_pos) for r in found if r.doc_id == i} == want, text
        assert all(r.value == text[r.start_pos : r.end_pos] for r in found if r.doc_id == i)


def test_locale_that_is_asked_for(spark):
    docs = frame(spark, [("A long English line with one 字,only here and nothing more", None)])
    assert [r.rule_id for r in locale.zh_cn_findings(docs, "zh-CN").collect()] == ["zh-cn-punct-width"]
    assert locale.zh_cn_findings(docs, "en").count() == 0


def generated(n):
    rng = random.Random(11)
    parts = ["中文", "测试,好", "Spark", "os.path", "`a,b`", "进行了", "被人所", "\n", "\n> q", "\n    x = 1", "\n| a | b |", "\n# 标题", " ", "snake_case", "(", "http://a.b/c", "[字](x)", "12%", "@me", "。", "\n$ ls", "\n---\n", "字a", "\n```json\n{}\n```\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def lines_of(text):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def slow_regions(text, base):
    found = []
    rules = [("indented_code", lambda s: re.match(r" {4,}\S", s)), ("table", lambda s: (s.strip().startswith("|") and s.strip().count("|") > 1) or ("-" in s and not set(s.strip()) - set(" \t:|-"))), ("blockquote", lambda s: s.startswith(">")), ("command", lambda s: re.match(r"\$\s+\S", s))]
    for name, rule in rules:
        run = None
        for at, line in lines_of(text):
            if rule(line):
                run = (run[0] if run else at, at + len(line))
            elif run:
                found.append((name, *run))
                run = None
        if run:
            found.append((name, *run))
    found += [("heading", at, at + len(line)) for at, line in lines_of(text) if re.match(r"#{1,6}\s+\S", line)]
    for m in re.finditer(r"(?ms)^`{3,}[^\n]*\n.*?^`{3,}[ \t]*$", text):
        found.append(("json_block" if m.group().startswith("```json") else "code_block", *m.span()))
    found += [("markdown_link", *m.span()) for m in re.finditer(r"\[[^\]\n]*\]\([^)\n]+\)", text)]
    found += base
    kept = []
    for span in sorted(found, key=lambda s: (s[1], -s[2])):
        if all(span[2] <= k[1] or k[2] <= span[1] for k in kept):
            kept.append(span)
    return kept


def slow_technical(text, regions):
    marked = [False] * len(text)
    spans = [s[1:] for s in regions] + [m.span() for p in (r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b|\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9_]*\b|\b[A-Za-z_][A-Za-z0-9_]*\s*\(", r"[#@][A-Za-z][A-Za-z0-9_]*|<[^>]+>") for m in re.finditer(p, text)]
    for a, b in spans:
        marked[a:b] = [True] * (b - a)
    return marked


def test_generated_texts_equal_slow_counterparts(spark):
    texts = generated(250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = {}
    for r in fidelity.protected_spans(docs).collect():
        base.setdefault(r.doc_id, []).append((r.category, r.start_pos, r.end_pos))
    regions = {(r.doc_id, r.category, r.start_pos, r.end_pos) for r in locale.repair_regions(docs).collect()}
    slow = {i: slow_regions(t, base.get(i, [])) for i, t in enumerate(texts)}
    assert regions == {(i, *s) for i, told in slow.items() for s in told}
    covered = {i: [False] * len(t) for i, t in enumerate(texts)}
    for r in locale.technical_spans(docs).collect():
        assert not any(covered[r.doc_id][r.start_pos : r.end_pos])
        covered[r.doc_id][r.start_pos : r.end_pos] = [True] * (r.end_pos - r.start_pos)
    assert covered == {i: slow_technical(t, slow[i]) for i, t in enumerate(texts)}
    want = set()
    for i, t in enumerate(texts):
        ink = re.sub(r"\s", "", t)
        if ink and len(re.findall(r"[一-鿿]", ink)) >= 0.1 * len(ink):
            blank = "".join(" " if m else c for c, m in zip(t, covered[i], strict=True))
            want |= {(i, p, *m.span()) for p in range(len(locale.ZH_RULES)) for m in re.finditer(locale.ZH_RULES[p][1], blank)}
    numbers = {label: n for n, (_, _, label) in enumerate(locale.ZH_RULES)}
    assert {(r.doc_id, numbers[r.pattern], r.start_pos, r.end_pos) for r in locale.zh_cn_findings(docs).collect()} == want and want


def test_regions_look_for_regions_alone(spark):
    """No anchor and no name of an interface is looked for where only regions are told; names still are for technical spans."""
    docs = spark.createDataFrame([(1, "It may not call os.path at 45% now")], "doc_id long, text string")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    regions, spans = locale.repair_regions(docs), locale.technical_spans(docs)
    anchor, name = "nobody|nothing", r"[a-z][a-zA-Z0-9]*[A-Z]"
    held = lambda frame, part: frame._jdf.queryExecution().analyzed().toString().replace(fidelity.T.quick(part), part).count(part)
    assert not held(regions, anchor) and not held(regions, name) and not held(spans, anchor) and held(spans, name)
    assert plan(regions).count("regexp_replace") < plan(spans).count("regexp_replace")
    assert {(r.category, r.start_pos) for r in regions.collect()} == {("number", 27)}
    assert {(r.category, r.start_pos) for r in spans.collect()} == {("api_name", 16), ("number", 27)}
