"""Links between neighbouring prose paragraphs: paragraphs that restate the one before, and runs that nothing ties together.

A paragraph ends at a blank line. Headings, quotes, tables, fences and list items are none. All is done in one pass over a
row's paragraphs, so texts are not shuffled; empty and null texts have no paragraphs, and repeated rows are each told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.limits import STOP_WORDS

BREAK = r"\n{2,}"
# Content words, what starts no prose, what ties a paragraph to the one before, what stands for code or links, limits
CONTENT_WORD, CONTENT_LETTERS = r"[A-Za-z][A-Za-z'-]*", 3
NO_PROSE = r"^[ \t\n\r\f]*(?:$|#|>|\||```|~~~|[-*+][ \t\n\r\f]|[0-9]+[.)][ \t\n\r\f])"
CONNECTIVE = (
    r"(?i)^[ \t\n\r\f]*(?:because|but|however|therefore|thus|so|then|instead|that|this|these|those|such|after|before|once|while|although|as a result|for that reason)(?:[^a-z0-9_]|$)"
)
HEADING_LINE, LITERAL = r"(?m)^#{1,6}[ \t]+", r"`|https?://|<details"
TREADMILL_WORDS, TREADMILL_OVERLAP = 6, 0.6
ISLAND_WORDS, ISLAND_OVERLAP, ISLAND_RUN = 7, 0.12, 3


def content_words(body: Column) -> Column:
    found = F.transform(F.regexp_extract_all(body, F.lit(T.quick(CONTENT_WORD)), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= CONTENT_LETTERS) & ~w.isin(*STOP_WORDS)))


def prose(text: Column, least_words: int) -> Column:
    """Array of (start, end, body, words) of the prose paragraphs of ``least_words`` distinct content words or more."""
    starts = F.concat(F.array(F.lit(0)), F.transform(T.spans(text, BREAK), lambda g: g["end"]))
    cut = F.zip_with(F.split(text, BREAK, -1), starts, lambda p, s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), p.alias("body")))
    held = F.filter(cut, lambda p: ~F.startswith(p["body"], F.lit("\n")) & ~F.regexp_like(p["body"], F.lit(NO_PROSE)))
    told = F.transform(held, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["body"].alias("body"), content_words(p["body"]).alias("words")))
    return F.filter(told, lambda p: F.size(p["words"]) >= least_words)


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    """How many words two sets share, and that as a share of the smaller; null where one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared, F.try_divide(shared.cast("double"), F.least(F.size(a), F.size(b)).cast("double"))


def linked(text: Column) -> Column:
    """``prose`` of the paragraphs that both links below may ask for; a text without a break is one paragraph, of which no words are
    looked for."""
    return F.when(F.contains(text, F.lit("\n\n")), prose(text, min(TREADMILL_WORDS, ISLAND_WORDS)))


def _of_words(held: Column, least: int) -> Column:
    return F.filter(held, lambda p: F.size(p["words"]) >= least)


def restating(text: Column, held: Column | None = None) -> Column:
    """Array of (start_pos, end_pos, shared, overlap) of the paragraphs that restate the prose paragraph before; ``held`` is the text's
    ``linked`` if that is a column already."""
    none = F.array().cast("array<struct<start_pos:int,end_pos:int,shared:int,overlap:double>>")

    def step(acc, p):
        shared, overlap = _shared(acc["words"], p["words"])
        one = F.array(F.struct(p["start"].alias("start_pos"), p["end"].alias("end_pos"), shared.alias("shared"), overlap.alias("overlap")))
        found = F.when(F.coalesce(overlap >= TREADMILL_OVERLAP, F.lit(False)), F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct(p["words"].alias("words"), found.alias("found"))

    start = F.struct(F.array().cast("array<string>").alias("words"), none.alias("found"))
    held = linked(text) if held is None else held
    return F.when(F.contains(text, F.lit("\n\n")), F.aggregate(_of_words(held, TREADMILL_WORDS), start, step, lambda acc: acc["found"])).when(text.isNotNull(), none)


def treadmill_prose(docs: DataFrame) -> DataFrame:
    """Paragraphs that mostly restate the content words of the prose paragraph before."""
    rows = docs.where("text is not null").select("doc_id", F.inline(restating(F.col("text"))))
    return rows.select("doc_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), F.col("shared").cast("long").alias("shared"), F.round("overlap", 6).alias("overlap"))


def untied(text: Column, held: Column | None = None) -> Column:
    """(start_pos, end_pos) of the first three prose paragraphs in a row that nothing ties together, or null."""
    none = F.lit(None).cast("struct<start_pos:int,end_pos:int>")

    def step(acc, p):
        between = F.substring(text, acc["end"] + 1, p["start"] - acc["end"])
        tied = F.regexp_like(between, F.lit(HEADING_LINE)) | F.regexp_like(p["body"], F.lit(CONNECTIVE)) | (_shared(acc["words"], p["words"])[1] >= ISLAND_OVERLAP)
        run = F.when(F.regexp_like(p["body"], F.lit(LITERAL)), F.lit(0)).when((acc["run"] > 0) & ~tied, acc["run"] + 1).otherwise(F.lit(1))
        hit = F.when(run >= ISLAND_RUN, F.struct(acc["before"].alias("start_pos"), p["end"].alias("end_pos")))
        return F.struct(acc["start"].alias("before"), p["start"].alias("start"), p["end"].alias("end"), p["words"].alias("words"), run.alias("run"), F.coalesce(acc["found"], hit).alias("found"))

    start = F.struct(F.lit(0).alias("before"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("words"), F.lit(0).alias("run"), none.alias("found"))
    held = linked(text) if held is None else held
    return F.when(F.contains(text, F.lit("\n\n")), F.aggregate(_of_words(held, ISLAND_WORDS), start, step, lambda acc: acc["found"]))


def paragraph_reshuffle(docs: DataFrame) -> DataFrame:
    """The first three prose paragraphs in a row, without code and links, that no heading, connective or shared words tie together."""
    rows = docs.select("doc_id", untied(F.col("text")).alias("f")).where("f is not null")
    return rows.select("doc_id", F.col("f.start_pos").cast("long").alias("start_pos"), F.col("f.end_pos").cast("long").alias("end_pos"))
