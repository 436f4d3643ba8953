"""Findings of document-level detectors, worked out inside a row as arrays of (start, end).

Sections run from heading to heading; a detector that judges a section points to the whole of it (evidence ``document``), one
that judges paragraphs or headings to those (evidence ``span``). Nothing is exploded or shuffled here: ``detect.found_in``
unites these arrays with the matches of patterns. Null and empty texts have none. Paragraphs are compared with all earlier ones
of their section, so the work for a text grows with the square of its paragraphs, as the detector is defined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text as T
from . import linkage

TRIM = " \t\n\r"
PLACE = "array<struct<start:int,end:int>>"
#: Blank lines, and the blank space around a paragraph that stands next to none.
BLANK_LINES, LEADING, TRAILING = r"\n\s*\n", r"^\s*\n", r"\n\s*\z"


class Measure(NamedTuple):
    key: str
    signal: str
    evidence: str
    find: Callable[[dict[str, Column]], Column]  # of the columns text, folded, code_quotes, sections, prose and held
    words: tuple[str, ...] = ()  # whole words of which a lower-cased text must hold one; those that it holds are in ``held``


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def words(text: Column) -> Column:
    return F.size(T.words_of(text))


def cut_at(text: Column, pattern: str, sign: str = "\n") -> Column:
    """Array of (start, end, body) of what stands between a pattern's matches, each of which holds ``sign``; empty pieces are left out."""
    starts = F.concat(F.array(F.lit(0)), F.transform(T.spans(text, pattern), lambda g: g["end"]))
    pieces = F.zip_with(F.split(text, pattern, -1), starts, lambda p, s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), p.alias("body")))
    # A text that is not cut, as most are, is looked through once
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("body")))
    likely = F.contains(text, F.lit(sign)) & F.regexp_like(text, F.lit(pattern))
    return F.filter(F.when(likely, pieces).when(text.isNotNull(), whole), lambda p: p["body"] != "")


def flat(body: Column) -> Column:
    """The prose lines of a section, joined by spaces."""
    unfenced = F.when(F.contains(body, F.lit("```")), F.regexp_replace(body, L.FENCE, " ")).otherwise(body)
    bare = F.when(F.contains(body, F.lit("<!--")), F.regexp_replace(unfenced, L.COMMENT, " ")).otherwise(unfenced)
    lines = F.filter(F.transform(F.split(bare, "\n", -1), trimmed), lambda x: (x != "") & ~F.regexp_like(x, F.lit(L.NO_PROSE_START)))
    return F.array_join(lines, " ")


def sections(folded: Column) -> Column:
    """Array of (start, end, body, flat, sentences, paragraphs); paragraphs are (start, end, t, n) of prose, from the text's start.

    Sentences are (s, n). The words n of sentences and paragraphs are counted where there are as many as some detector asks for,
    else null.
    """

    def paragraph(section: Column) -> Column:
        placed = F.transform(cut_at(section["body"], T.PARAGRAPH_END), lambda p: F.struct((section["start"] + p["start"]).alias("start"), (section["start"] + p["end"]).alias("end"), trimmed(p["body"]).alias("t")))
        prose = F.filter(placed, lambda p: (p["t"] != "") & ~F.regexp_like(p["t"], F.lit(L.NO_PROSE_START)))
        return T.let(prose, lambda all_: F.transform(all_, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["t"].alias("t"), F.when(F.size(all_) >= 2, words(p["t"])).alias("n"))))

    made = F.transform(cut_at(folded, L.HEADING, "#"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), flat(s["body"]).alias("flat"), paragraph(s).alias("paragraphs")))

    def told(s: Column) -> Column:
        counted = lambda all_: F.transform(all_, lambda x: F.struct(x.alias("s"), F.when(F.size(all_) >= min(L.SENTENCE_MIN, L.PASSIVE_SENTENCES), words(x)).alias("n")))
        return T.let(F.filter(F.split(s["flat"], T.SENTENCE_END, -1), lambda x: x != ""), counted)

    return F.transform(made, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["flat"].alias("flat"), told(s).alias("sentences"), s["paragraphs"].alias("paragraphs")))


def _places(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))


def _sections_where(holds: Callable[[Column], Column]) -> Callable[[dict[str, Column]], Column]:
    return lambda c: _places(F.filter(c["sections"], holds))


def _even(lengths: Column, least: int, mean: float, limit: float) -> Column:
    """Whether there are enough lengths, long enough on average, that vary too little; sums are of whole numbers."""

    def judged(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        squares = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        spread = F.sqrt((F.size(n) * squares - total * total).cast("double")) / total
        return (F.size(n) >= least) & (total >= F.size(n) * F.lit(mean)) & (spread < F.lit(limit))

    return F.coalesce(T.let(lengths, judged), F.lit(False))


def _even_sentences(s: Column) -> Column:
    return _even(F.filter(F.transform(s["sentences"], lambda x: x["n"]), lambda n: n >= L.SENTENCE_MIN_WORDS), L.SENTENCE_MIN, L.MEAN_MIN, L.SENTENCE_CV)


def _even_paragraphs(s: Column) -> Column:
    return _even(F.filter(F.transform(s["paragraphs"], lambda p: p["n"]), lambda n: n >= L.PARAGRAPH_MIN_WORDS), L.PARAGRAPH_MIN, 0.0, L.PARAGRAPH_CV)


def _openers(s: Column) -> Column:
    first = F.transform(s["sentences"], lambda x: F.regexp_extract(F.lower(F.regexp_extract(x["s"], T.WORD, 0)), "[a-z].*", 0))

    def judged(f: Column) -> Column:
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

        def step(acc, w):
            n = F.when(acc["w"] == w, acc["n"] + 1).otherwise(1)
            return F.struct(w.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

        most = F.aggregate(F.array_sort(f), start, step, lambda acc: acc["most"])
        return (F.size(f) >= L.OPENER_SENTENCES) & (most >= L.OPENER_COUNT) & (most > F.size(f) * F.lit(L.OPENER_SHARE))

    return (F.size(s["sentences"]) >= L.OPENER_SENTENCES) & T.let(F.filter(first, lambda w: F.length(w) >= 2), judged)


def _transitions(s: Column) -> Column:
    def judged(lower: Column) -> Column:
        held = F.lit(False)
        for term in L.TRANSITIONS:
            held = held | (F.contains(lower, F.lit(term)) & (T.count_of(lower, rf"\b{term}\b") >= L.TRANSITION_COUNT))
        return held

    return T.let(F.lower(s["flat"]), judged)


#: The last word of each transition.
TRANSITION_WORDS = tuple(t.split()[-1] for t in L.TRANSITIONS)


def _repeated_transitions(c: dict[str, Column]) -> Column:
    """Sections of a text that holds none of the words are not looked through."""
    return F.when(F.arrays_overlap(c["held"], F.array(*map(F.lit, TRANSITION_WORDS))), _sections_where(_transitions)(c))


def _passive(s: Column) -> Column:
    stop = F.array(*map(F.lit, L.ADJECTIVES))
    passive = lambda x: F.exists(F.regexp_extract_all(x["s"], F.lit(L.PASSIVE), F.lit(1)), lambda w: ~F.array_contains(stop, F.lower(w)))

    def judged(told: Column) -> Column:
        # No match reaches over the end of a sentence, so a section holds at least as many as its sentences
        likely = (F.size(told) >= L.PASSIVE_SENTENCES) & (T.count_of(s["flat"], T.beginning("abiw", L.PASSIVE)) >= L.PASSIVE_COUNT)
        return likely & T.let(F.size(F.filter(told, passive)), lambda n: (n >= L.PASSIVE_COUNT) & (n > F.size(told) * F.lit(L.PASSIVE_SHARE)))

    return T.let(F.filter(s["sentences"], lambda x: x["n"] >= L.SENTENCE_MIN_WORDS), judged)


def _repeating(alike: Callable[[Column, Column], Column]) -> Callable[[dict[str, Column]], Column]:
    """Later paragraphs that are like an earlier one; an earlier one accuses the first later one that is not accused yet, and one
    that is accused accuses none."""

    def section(s: Column) -> Column:
        long = F.filter(s["paragraphs"], lambda p: p["n"] >= L.SIMILAR_WORDS)
        told = lambda ps: F.transform(ps, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), T.word_set(p["t"]).alias("w"), F.regexp_replace(F.lower(p["t"]), r"[^a-z0-9\s]", "").alias("plain")))

        def accused(p: Column) -> Column:
            def step(flagged, i):
                later = F.filter(F.sequence(i + 1, F.size(p) - 1), lambda j: ~F.array_contains(flagged, j) & alike(F.get(p, i), F.get(p, j)))
                return F.when(F.array_contains(flagged, i), flagged).otherwise(F.concat(flagged, F.slice(later, 1, 1)))

            none = F.array().cast("array<int>")
            found = F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), none, step)
            return F.transform(F.when(F.size(p) >= 2, found).otherwise(none), lambda j: F.get(p, j))

        none = F.array().cast(PLACE)
        return T.let(long, lambda ps: F.when(F.size(ps) >= 2, _places(T.let(told(ps), accused))).otherwise(none))

    # Spans of one detector are told in the order of the text
    return lambda c: F.array_sort(F.flatten(F.transform(c["sections"], section)))


def _jaccard_above(limit: float, shared: int = 0) -> Callable[[Column, Column], Column]:
    """Sets whose sizes alone rule the likeness out are not intersected."""

    def alike(a: Column, b: Column) -> Column:
        least, most = F.least(F.size(a["w"]), F.size(b["w"])), F.greatest(F.size(a["w"]), F.size(b["w"]))
        both = F.size(F.array_intersect(a["w"], b["w"]))
        return (least > most * F.lit(limit)) & (both > (least + most - both) * F.lit(limit)) & (both >= shared)

    return alike


def _duplicate(a: Column, b: Column) -> Column:
    return (a["plain"] == b["plain"]) | _jaccard_above(L.DUPLICATE)(a, b)


def _semicolons(c: dict[str, Column]) -> Column:
    def placed(p: Column) -> Column:
        before, after = F.length(F.regexp_extract(p["body"], LEADING, 0)), F.length(F.regexp_extract(p["body"], TRAILING, 0))
        return F.struct((p["start"] + before).cast("int").alias("start"), (p["end"] - after).cast("int").alias("end"))

    text = c["code_quotes"]
    found = F.filter(cut_at(text, BLANK_LINES), lambda p: T.count_of(p["body"], ";") >= 2)
    return F.when(F.contains(text, F.lit(";")), F.transform(found, placed))


def _title_case(c: dict[str, Column]) -> Column:
    small, names = (F.array(*map(F.lit, x)) for x in (L.HEADING_SMALL, L.HEADING_NAMES))

    def judged(w: Column) -> Column:
        tail = F.filter(F.slice(w, F.lit(2), F.size(w)), lambda x: ~F.array_contains(small, F.lower(x)))
        named = F.array_contains(names, F.lower(F.get(w, 0))) | F.forall(tail, lambda x: F.array_contains(names, F.lower(x)))
        return (F.size(w) >= 2) & (F.size(tail) > 0) & ~named & F.forall(tail, lambda x: F.regexp_like(x, F.lit("^[A-Z]")))

    tokens = lambda h: F.regexp_extract_all(F.regexp_replace(h["value"], r"^#+\s+", ""), F.lit(L.HEADING_WORD), F.lit(0))
    text = c["code_quotes"]
    return F.when(F.contains(text, F.lit("#")), _places(F.filter(T.spans(text, L.HEADING_LINE), lambda h: F.coalesce(T.let(tokens(h), judged), F.lit(False)))))


def _skipped_levels(c: dict[str, Column]) -> Column:
    def judged(h: Column) -> Column:
        level = lambda x: F.length(F.regexp_extract(x["value"], "^#+", 0))
        return F.filter(F.transform(h, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), ((i > 0) & (level(x) > level(F.get(h, i - 1)) + 1)).alias("skips"))), lambda x: x["skips"])

    text = c["folded"]
    return F.when(F.contains(text, F.lit("#")), _places(T.let(T.spans(text, L.HEADING_LINE), judged)))


def _treadmill(c: dict[str, Column]) -> Column:
    return F.transform(linkage.restating(c["text"], c["prose"]), lambda x: F.struct(x["start_pos"].cast("int").alias("start"), x["end_pos"].cast("int").alias("end")))


def _reshuffle(c: dict[str, Column]) -> Column:
    one = lambda x: F.array(F.struct(x["start_pos"].cast("int").alias("start"), x["end_pos"].cast("int").alias("end")))
    return T.let(linkage.untied(c["text"], c["prose"]), lambda x: F.when(x.isNotNull(), one(x)))


MEASURES = [
    Measure("paragraph_duplication", "strict", "span", _repeating(_duplicate)),
    Measure("passive_density", "strict", "document", _sections_where(_passive)),
    Measure("fmt_title_case", "strict", "span", _title_case),
    Measure("paragraph_similarity", "advisory", "span", _repeating(_jaccard_above(L.SIMILAR, L.SIMILAR_SHARED))),
    Measure("sentence_length_variance", "advisory", "document", _sections_where(_even_sentences)),
    Measure("paragraph_length_variance", "advisory", "document", _sections_where(_even_paragraphs)),
    Measure("sentence_start_repetition", "advisory", "document", _sections_where(_openers)),
    Measure("transition_repetition", "advisory", "document", _repeated_transitions, TRANSITION_WORDS),
    Measure("fmt_semicolon", "advisory", "document", _semicolons),
    Measure("heading_hierarchy", "advisory", "span", _skipped_levels),
    Measure("treadmill_prose", "advisory", "span", _treadmill),
    Measure("paragraph_reshuffle", "advisory", "span", _reshuffle),
]


@cache
def _united(gateway: object, measures: tuple[Measure, ...]) -> tuple[Column, Column, Column]:
    columns = {"text": F.col("text"), "folded": F.col("_folded"), "code_quotes": F.col("_code_quotes"), "sections": F.col("_sections"), "prose": F.col("_linked"), "held": F.col("_held")}
    found = [F.struct(F.lit(i).alias("rule"), m.find(columns).cast(PLACE).alias("at")) for i, m in enumerate(measures)]
    return sections(F.col("_folded")), linkage.linked(F.col("text")), F.array(*found)


def united(measures: tuple[Measure, ...]) -> tuple[Column, Column, Column]:
    """Sections of the column ``_folded``, linked prose of ``text``, and the array of (rule, at) made from them as ``_sections`` and
    ``_linked``, from ``text``, ``_folded``, ``_code_quotes`` and ``_held``. The expressions take seconds to make, so they are made once."""
    return _united(SparkContext._gateway, measures)
