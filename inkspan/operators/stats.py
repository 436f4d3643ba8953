"""Document-level measures over sections of prose: rhythm, openers, transitions, passives, paragraphs, lists, headings.

A section is what follows a heading, or the whole text; text before the first heading is a section too. Measures are made
with array functions inside a row, so a text is never shuffled; empty and null texts have no sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.limits import (  # noqa: F401
    ADJECTIVES,
    DUPLICATE,
    HEADING,
    HEADING_SMALL,
    MEAN_MIN,
    OPENER_COUNT,
    OPENER_SENTENCES,
    OPENER_SHARE,
    PARAGRAPH_CV,
    PARAGRAPH_MIN,
    PARAGRAPH_MIN_WORDS,
    PASSIVE,
    PASSIVE_COUNT,
    PASSIVE_SENTENCES,
    PASSIVE_SHARE,
    SENTENCE_CV,
    SENTENCE_MIN,
    SENTENCE_MIN_WORDS,
    SIMILAR,
    SIMILAR_SHARED,
    SIMILAR_WORDS,
    STOP_WORDS,
    TRANSITIONS,
    TRANSITION_COUNT,
)
from . import detect

SKIPPED_LINE = r"^(?:#|\||>|[-*] |[0-9]\.)"
# Limits of long sentences
COMMAS, LONG_WORDS = 5, 10
TRIM = " \t\n\r"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2FA1F}]"


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, row (the row's own key), section (0, 1, ...), body (code blanked) and flat (prose lines joined by spaces) of each
    section that is not blank."""
    folded = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), T.mask_code(T.folded(F.col("text"))).alias("t"))
    cut = folded.select("doc_id", "row", F.posexplode(F.split("t", HEADING, -1)).alias("section", "body")).where(F.btrim("body", F.lit(TRIM)) != "")
    lines = F.filter(F.transform(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(TRIM))), lambda x: (x != "") & ~F.regexp_like(x, F.lit(SKIPPED_LINE)))
    return cut.select("doc_id", "row", F.col("section").cast("long").alias("section"), "body", F.array_join(lines, " ").alias("flat"))


def _words(s: Column) -> Column:
    return F.size(T.words_of(s))


def rhythm(docs: DataFrame) -> DataFrame:
    """Sentence and paragraph length variation of each section, and whether each is too even."""
    made = sections(docs).withColumn("lengths", F.filter(F.transform(T.sentences(F.col("flat")), _words), lambda n: n >= SENTENCE_MIN_WORDS)).withColumn("paras", F.filter(F.transform(T.paragraphs(F.col("body")), _words), lambda n: n >= PARAGRAPH_MIN_WORDS))
    told = made.select("doc_id", "section", F.size("lengths").cast("long").alias("sentences"), F.round(T.mean(F.col("lengths")), 4).alias("mean_words"), F.round(T.variation(F.col("lengths")), 4).alias("sentence_cv"), F.size("paras").cast("long").alias("paragraphs"), F.round(T.variation(F.col("paras")), 4).alias("paragraph_cv"))
    even = (F.col("sentences") >= SENTENCE_MIN) & (F.col("mean_words") >= MEAN_MIN) & (F.col("sentence_cv") < SENTENCE_CV)
    even_paragraphs = (F.col("paragraphs") >= PARAGRAPH_MIN) & (F.col("paragraph_cv") < PARAGRAPH_CV)
    return told.withColumns({"even_sentences": F.coalesce(even, F.lit(False)), "even_paragraphs": F.coalesce(even_paragraphs, F.lit(False))})


def openers(docs: DataFrame) -> DataFrame:
    """The commonest first word of each section's sentences; the first seen wins a tie."""
    first = F.transform(T.sentences(F.col("flat")), lambda s: F.regexp_extract(F.lower(F.split(s, " ")[0]), "[a-z].*", 0))
    made = sections(docs).withColumn("first", F.filter(first, lambda w: F.length(w) >= 2))
    rows = made.select("doc_id", "row", "section", F.size("first").alias("n"), F.posexplode("first").alias("at", "opener"))
    counted = rows.groupBy("row", "doc_id", "section", "opener").agg(F.max("n").cast("long").alias("openings"), F.count(F.lit(1)).alias("times"), F.min("at").alias("at"))
    best = F.row_number().over(Window.partitionBy("row", "section").orderBy(F.col("times").desc(), "at"))
    top = counted.withColumn("rank", best).where("rank = 1")
    share = F.col("times") / F.col("openings")
    flagged = (F.col("openings") >= OPENER_SENTENCES) & (F.col("times") >= OPENER_COUNT) & (share > OPENER_SHARE)
    return top.select("doc_id", "section", "opener", "openings", "times", F.round(share, 4).alias("share"), flagged.alias("repeated"))


def transitions(docs: DataFrame) -> DataFrame:
    """The first transition of the list that a section has three times or more."""
    lower = F.lower("flat")
    counts = F.array(*[F.struct(F.lit(t).alias("term"), T.count_of(lower, rf"\b{t}\b").cast("long").alias("times")) for t in TRANSITIONS])
    held = sections(docs).select("doc_id", "section", F.filter(counts, lambda c: c["times"] >= TRANSITION_COUNT).alias("c")).where("size(c) > 0")
    return held.select("doc_id", "section", F.col("c")[0]["term"].alias("term"), F.col("c")[0]["times"].alias("times"))


def passives(docs: DataFrame) -> DataFrame:
    """Sentences of each section and those with a passive form, and whether passives prevail."""
    stop = F.array(*map(F.lit, ADJECTIVES))
    passive = lambda s: F.exists(F.regexp_extract_all(s, F.lit(PASSIVE), F.lit(1)), lambda w: ~F.array_contains(stop, F.lower(w)))
    made = sections(docs).withColumn("s", T.sentences(F.col("flat")))
    told = made.select("doc_id", "section", F.size("s").cast("long").alias("sentences"), F.size(F.filter("s", passive)).cast("long").alias("passive"))
    heavy = (F.col("sentences") >= PASSIVE_SENTENCES) & (F.col("passive") >= PASSIVE_COUNT) & (F.col("passive") / F.col("sentences") > PASSIVE_SHARE)
    return told.where("passive > 0").withColumn("passive_heavy", heavy)


def long_sentences(docs: DataFrame) -> DataFrame:
    """Sentences of five commas or more and ten words or more, by place in their section."""
    rows = sections(docs).select("doc_id", "section", F.posexplode(T.sentences(F.col("flat"))).alias("at", "s"))
    told = rows.select("doc_id", "section", F.col("at").cast("long").alias("sentence"), T.count_of(F.col("s"), ",").cast("long").alias("commas"), _words(F.col("s")).cast("long").alias("words"))
    return told.where((F.col("commas") >= COMMAS) & (F.col("words") >= LONG_WORDS))


def semicolons(docs: DataFrame) -> DataFrame:
    """Paragraphs with two semicolons or more, code and quotes aside."""
    rows = docs.select("doc_id", F.posexplode(T.paragraphs(T.mask_code_and_quotes(T.folded(F.col("text"))))).alias("at", "p"))
    return rows.select("doc_id", F.col("at").cast("long").alias("paragraph"), T.count_of(F.col("p"), ";").cast("long").alias("semicolons")).where("semicolons >= 2")


def similar_paragraphs(docs: DataFrame) -> DataFrame:
    """Each paragraph of enough words that resembles an earlier one of its document: the most similar, the first of equals.

    Paragraphs are compared inside their row; no pairs of rows are made.
    """
    sets = F.filter(F.transform(T.paragraphs(T.mask_code(T.folded(F.col("text")))), T.word_set), lambda w: F.size(w) >= SIMILAR_WORDS)
    made = docs.select("doc_id", sets.alias("sets")).where("size(sets) > 1")
    rows = made.select("doc_id", "sets", F.posexplode("sets").alias("at", "own")).where("at > 0")
    scored = F.transform(F.slice("sets", F.lit(1), F.col("at")), lambda w, i: F.struct(F.round(T.jaccard(w, F.col("own")), 6).alias("score"), (-i).alias("i"), F.size(F.array_intersect(w, F.col("own"))).alias("shared")))
    best = F.array_max(F.filter(scored, lambda x: (x["score"] > SIMILAR) & (x["shared"] >= SIMILAR_SHARED)))
    told = rows.select("doc_id", F.col("at").cast("long").alias("paragraph"), best.alias("b")).where("b is not null")
    return told.select("doc_id", "paragraph", (-F.col("b.i")).cast("long").alias("earlier"), F.col("b.score").alias("jaccard"), (F.col("b.score") > DUPLICATE).alias("duplicate"))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with their row's own key, which is made before a row becomes several."""
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return keyed.select("doc_id", "row", F.posexplode(F.split(T.mask_code(T.folded(F.col("text"))), "\n", -1)).alias("line", "s"))


def headings(docs: DataFrame) -> DataFrame:
    """Headings in order, with level, whether a level is skipped, and whether the heading is in title case."""
    lines = _lines(docs).where(F.regexp_like("s", F.lit(r"^#{1,6}\s+\S")))
    told = lines.select("doc_id", "row", F.col("line").cast("long").alias("line"), F.length(F.regexp_extract("s", "^#+", 0)).cast("long").alias("level"), F.filter(F.split(F.regexp_replace("s", r"^#+\s+", ""), r"\s+"), lambda w: w != "").alias("w"))
    before = F.lag("level").over(Window.partitionBy("row").orderBy("line"))
    small = F.array(*map(F.lit, HEADING_SMALL))
    tail = F.filter(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda x: ~F.array_contains(small, F.lower(x)))
    titled = (F.size("w") >= 2) & (F.size(tail) > 0) & F.forall(tail, lambda x: F.regexp_like(x, F.lit("^[A-Z]")))
    return told.select("doc_id", "line", "level", F.coalesce(F.col("level") > before + 1, F.lit(False)).alias("skips"), titled.alias("title_case"))


def numbered_runs(docs: DataFrame) -> DataFrame:
    """Runs of five or more list lines that are numbered one after the other."""
    item = r"^\s*([0-9]{1,6})[.)]\s+\S"
    lines = _lines(docs).where(F.regexp_like("s", F.lit(item)))
    told = lines.select("doc_id", "row", F.col("line").cast("long").alias("line"), F.regexp_extract("s", item, 1).cast("long").alias("number"))
    runs = told.groupBy("doc_id", "row", (F.col("line") - F.col("number")).alias("run")).agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("items"))
    return runs.where("items >= 5").select("doc_id", "first_line", "items")


def stylometrics(docs: DataFrame) -> DataFrame:
    """Words, sentences, mean sentence length, share of distinct words, punctuation per word and share of Han characters."""
    t = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", T.folded(t).alias("f"), t.alias("t")).withColumn("w", T.words_of(F.lower("f")))
    words, marks = F.size("w"), T.count_of(F.col("f"), r"[.,;:!?]")
    inked, han = T.count_of(F.col("t"), r"\S"), T.count_of(F.col("t"), HAN)
    sentences = F.size(T.sentences(F.col("f")))
    return made.select(
        "doc_id",
        words.cast("long").alias("words"),
        sentences.cast("long").alias("sentences"),
        F.when(sentences > 0, F.round(words / sentences, 4)).alias("mean_words"),
        F.when(words > 0, F.round(F.size(F.array_distinct("w")) / words, 4)).alias("distinct_share"),
        F.when(words > 0, F.round(marks / words, 4)).alias("punctuation"),
        F.when((inked > 0) & (han / inked >= 0.1), "zh-CN").otherwise("other").alias("locale"),
    )


def passage_density(docs: DataFrame, span: int = 100, least: int = 3) -> DataFrame:
    """Pattern findings from which on ``least`` distinct rules or more are found within ``span`` words; of each row that has any."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = detect.all_findings(rows, keep=("doc_id", "row", "text"), measured=False)
    at = found.select("doc_id", "row", "rule_id", "start_pos", T.word_count(F.substring(F.col("text"), F.lit(1), F.col("start_pos").cast("int"))).cast("long").alias("word"))
    ahead = Window.partitionBy("row").orderBy("word").rangeBetween(0, span - 1)
    counted = at.withColumn("rules", F.size(F.collect_set("rule_id").over(ahead)).cast("long"))
    return counted.where(F.col("rules") >= least).groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("places"), F.max("rules").alias("most_rules"), F.min("word").alias("first_word")).drop("row")
