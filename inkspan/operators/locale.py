"""Regions that a repair must not touch, technical spans, and findings of Chinese prose outside of them.

Patterns find candidates inside the JVM. One Arrow helper works on numbers of a row alone: it joins lines of one kind to blocks,
lets the first and longest region stand where several overlap, and unites technical spans. Texts are then blanked and searched again
without leaving the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.workers import importable
from . import fidelity

_BLANK = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
_INK = r"[^\s\x1c-\x1f\x85\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"
_REST = r"[^\n]*"

# What blocks, links, names of interfaces and tags look like, and what is found in Chinese prose
#: Kinds of which neighbouring lines form one block.
RUNS = {
    "indented_code": rf"(?md)^ {{4,}}{_INK}{_REST}",
    "table": rf"(?md)^{_BLANK}*\|{_REST}\|{_REST}|^(?=(?:{_BLANK}|[:|])*+-)(?:{_BLANK}|[:|\-])++$",
    "blockquote": rf"(?md)^>{_REST}",
    "command": rf"(?md)^\${_BLANK}+{_INK}{_REST}",
}
LINES = {"heading": rf"(?md)^#{{1,6}}{_BLANK}+{_INK}{_REST}"}
LINK = {"markdown_link": r"\[[^\]\n]*\](?:\([^)\n]+\)|\[[^\]\n]*\]|:[^\n]*)"}
NAMES = {
    "api_name": rf"(?=[A-Za-z_])(?<!{_WORD})(?:[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)++|[a-z][a-z0-9]*+(?:_[a-z0-9]++)++(?!{_WORD})|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9_]*(?!{_WORD})|[A-Za-z_][A-Za-z0-9_]*+(?:{_BLANK}|\n)*+\()",
    "tag": r"(?=[#@<])(?:[#@][A-Za-z][A-Za-z0-9_]*|<[^>]+>)",
}
HAN = "[一-鿿]"
HAN_RATIO = 0.1
ZH_CN = "zh-CN"
ZH_RULES = (
    ("zh-cn-punct-width", rf"{HAN}[,.;:!?()]|[,.;:!?()]{HAN}", "half-width punctuation adjacent to Han"),
    ("zh-cn-spacing", rf"{HAN}[A-Za-z]|[A-Za-z]{HAN}", "missing Chinese-Western space"),
    ("zh-cn-translationese", rf"被{HAN}{{1,12}}所", "被X所 passive frame"),
    ("zh-cn-translationese", "进行了", "carried out verb-noun padding"),
    ("zh-cn-translationese", "这一现象", "vague this-phenomenon reference"),
    ("zh-cn-translationese", rf"在{HAN}{{1,12}}的过程中", "in the process of"),
)
FENCES = {"yaml": "yaml_block", "yml": "yaml_block", "json": "json_block"}

#: Regions in the order in which those of one place and length give way, the protected spans of the fidelity gate last.
CATEGORIES = (*RUNS, *LINES, "code_block", "yaml_block", "json_block", *LINK, *fidelity.PROTECTED, *NAMES)
_SPANS = "array<struct<category:string,start:int,end:int>>"
_NONE = "cast(array() as array<struct<category:int,start:int,end:int>>)"


def joined_lines(spans: list[tuple[int, int, int]], kinds: int = len(RUNS)) -> list[tuple[int, int, int]]:
    """Spans (category, start, end) in order of category and start; of the first kinds those that a line end alone parts are joined."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in spans:
        if out and kind < kinds and out[-1][0] == kind and out[-1][2] + 1 == start:
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, start, end))
    return out


def first_and_longest(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by start, the longer one first, that overlap none taken before."""
    out: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not out or out[-1][2] <= span[1]:
            out.append(span)
    return out


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans made one, of the first one's category."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


_FIELDS = ("regions", "region_starts", "region_ends", "spans", "span_starts", "span_ends")


@fidelity.helper(StructType([StructField(name, ArrayType(IntegerType())) for name in _FIELDS]))
def _settled(kinds: pd.Series, starts: pd.Series, ends: pd.Series, named: pd.Series, named_starts: pd.Series, named_ends: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, c, d, e, f in zip(kinds, starts, ends, named, named_starts, named_ends, strict=True):
        regions = first_and_longest(joined_lines(list(zip(a, b, c, strict=True))))
        spans = united(regions + list(zip(d, e, f, strict=True)))
        rows.append([[s[i] for s in told] for told in (regions, spans) for i in range(3)])
    return pd.DataFrame(rows, columns=list(_FIELDS))


def _found(text: str, category: str, pattern: str) -> str:
    return f"transform({T.spans_sql(text, pattern)}, s -> named_struct('category', {CATEGORIES.index(category)}, 'start', s.start, 'end', s.end))"


def _fences(text: str) -> str:
    number = lambda c: CATEGORIES.index(c)
    opening = "lower(regexp_extract(substring(s.value, 1, 8), '^```\\\\s*([A-Za-z0-9_+-]+)', 1))"
    kind = f"CASE {opening} " + " ".join(f"WHEN '{lang}' THEN {number(label)}" for lang, label in FENCES.items()) + f" ELSE {number('code_block')} END"
    return f"transform({T.spans_sql(text, fidelity.PROTECTED['code_block'])}, s -> named_struct('category', {kind}, 'start', s.start, 'end', s.end))"


def with_regions(rows: DataFrame, terms: tuple[str, ...] = (), named: bool = True) -> DataFrame:
    """``rows`` (with text) and two arrays of (category, start, end): ``regions`` that do not overlap, and ``technical`` spans, in
    which names of interfaces and tags are united with the regions they touch; unless ``named``, those are not looked for. A null
    text is the empty one."""
    importable(rows.sparkSession)
    found = fidelity.extracted(rows.withColumn("text", F.coalesce("text", F.lit(""))), {"text": "_f"}, terms, anchored=False).drop("_f_a")
    found = found.withColumn("_t", T.unmarked(F.col("text")))
    numbers = "map(" + ", ".join(f"'{c}', {CATEGORIES.index(c)}" for c in fidelity.PROTECTED) + ")"
    base = f"transform(_f_p, s -> named_struct('category', {numbers}[s.category], 'start', s.start, 'end', s.end))"
    lines = [_found("_t", c, p) for c, p in (RUNS | LINES).items()]
    found = found.withColumns({"_r": F.expr(f"concat({', '.join([*lines, _fences('_t'), _found('_t', 'markdown_link', LINK['markdown_link']), base])})"), "_n": F.expr(f"concat({', '.join(_found('_t', c, p) for c, p in NAMES.items())})" if named else _NONE)})
    fields = [F.expr(f"transform({name}, s -> s.{field})") for name in ("_r", "_n") for field in ("category", "start", "end")]
    found = found.withColumn("_s", _settled(*fields))
    listed = "array(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"
    told = lambda kind, start, end: F.expr(f"CAST(transform(arrays_zip(_s.{kind}, _s.{start}, _s.{end}), s -> named_struct('category', {listed}[s.{kind}], 'start', s.{start}, 'end', s.{end})) AS {_SPANS})")
    return found.withColumns({"regions": told(*_FIELDS[:3]), "technical": told(*_FIELDS[3:])}).drop("_f_p", "_t", "_r", "_n", "_s")


def _exploded(rows: DataFrame, name: str) -> DataFrame:
    # An outer explode is not preceded by a filter that would work the spans out once more
    return rows.select("doc_id", F.explode_outer(name).alias("s")).where("s IS NOT NULL").select("doc_id", "s.category", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"))


def repair_regions(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, category, start_pos, end_pos) of what a repair leaves byte for byte as it is."""
    return _exploded(with_regions(docs.select("doc_id", "text"), terms, named=False), "regions")


def technical_spans(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """``repair_regions`` united with names of interfaces and tags."""
    return _exploded(with_regions(docs.select("doc_id", "text"), terms), "technical")


def active_locale(text: Column, requested: str = "") -> Column:
    """zh-CN if it is asked for, or if nothing is and a tenth of what is no white space is Han; else the empty string."""
    if requested:
        return F.lit(ZH_CN if requested == ZH_CN else "")
    ink = F.length(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]+", ""))
    return F.when((ink > 0) & (T.count_of(text, HAN) / F.greatest(ink, F.lit(1)) >= HAN_RATIO), ZH_CN).otherwise("")


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with a space for each character inside ``spans``, which are in order and do not overlap."""

    def told(x: Column) -> Column:
        held, s = x["held"], x["spans"]
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])
        cut = F.transform(s, lambda p, i: F.concat(F.when(p["start"] > before(i), T.taken(held, before(i), p["start"] - before(i))).otherwise(""), F.repeat(F.lit(" "), p["end"] - p["start"])))
        last = F.element_at(s, -1)["end"]
        return F.concat(F.array_join(cut, ""), F.when(x["n"] > last, T.taken(held, last, x["n"] - last)).otherwise(""))

    held = F.struct(T.parts(text).alias("held"), spans.alias("spans"), F.length(text).alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(T.let(held, told))


def zh_cn_findings(docs: DataFrame, requested: str = "", terms: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, rule_id, pattern, start_pos, end_pos, value) of half-width signs, missing spaces and translated phrases beside Han.

    Only texts whose locale is active are read further; what lies in a technical span is blanked before.
    """
    active = docs.select("doc_id", "text").where(active_locale(F.coalesce("text", F.lit("")), requested) == ZH_CN)
    rows = with_regions(active, terms).withColumn("_b", T.unmarked(blanked(F.col("text"), F.col("technical"))))
    of = [f"transform({T.spans_sql('_b', p)}, s -> named_struct('rule', {i}, 'start', s.start, 'end', s.end, 'value', s.value))" for i, (_, p, _) in enumerate(ZH_RULES)]
    told = rows.select("doc_id", F.explode_outer(F.expr(f"concat({', '.join(of)})")).alias("s")).where("s IS NOT NULL")
    named = lambda n: F.get(F.array(*[F.lit(r[n]) for r in ZH_RULES]), F.col("s.rule"))
    return told.select("doc_id", named(0).alias("rule_id"), named(2).alias("pattern"), F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"), "s.value")
