"""Claims of a text and the evidence each has in a source: source, experience, logic, inference or unknown, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_LETTER = r"\p{L}\p{N}_"

# What ends a claim, and words that tell what it rests on
CLAIM_END = rf"[。！？!?]|\.(?=[{_SPACE}]|\z)"
EXPERIENCE = r"(?i)\b(?:I|we|my|our|I've|we've|I'm|we're|I saw|we saw|in my experience|as someone who)\b"
LOGIC = r"(?i)\b(?:because|therefore|thus|hence|so|since|consequently|if|then|implies|means|leads to|caused|as a result)\b"
INFERENCE = r"(?i)\b(?:likely|probably|suggests?|appears?|seems?|may|might|could|possibly|presumably|implies|indicates?)\b"
FACT_WORD = rf"[{_LETTER}](?:[{_LETTER}'-]*[{_LETTER}])?"
CLASSES = ("source", "logic", "experience", "inference", "unknown")
GROUNDED = ("source", "logic")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def claims_of(text: Column) -> Column:
    """Array of (start, end, claim): a full stop ends a claim only before white space or the end of the text.

    start and end hold the white space around a claim; blank ones are left out. Of a null text there are none.
    """
    kind = "array<struct<start:int,end:int,claim:string>>"

    def told(x: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1))
        every = F.transform(x["ends"], lambda end, i: F.struct(start(i).alias("start"), end.alias("end"), F.when(end > start(i), stripped(T.taken(x["held"], start(i), end - start(i)))).otherwise("").alias("claim")))
        return F.filter(every, lambda c: c["claim"] != "")

    ends = F.concat(F.transform(T.placed(T.lengths(T.pieces(text, CLAIM_END))), lambda at: at["end"]), F.array(F.length(text)))
    return F.when(F.length(text) > 0, T.let(F.struct(ends.alias("ends"), T.parts(text).alias("held")), told)).otherwise(F.array().cast(kind))


def fact_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(FACT_WORD), F.lit(0))


def _forms(last: Column) -> Column:
    """A fact's last word and its inflected forms, which words of three letters or more have."""
    inflected = F.concat(F.transform(F.array(*map(F.lit, ("", "s", "ed", "ing"))), lambda e: F.concat(last, e)), F.when(F.endswith(last, F.lit("e")), F.array(F.concat(last, F.lit("d")))).when(F.endswith(last, F.lit("y")), F.array(F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.lit("ies")))).otherwise(F.array().cast("array<string>")))
    return F.when(F.regexp_like(last, F.lit(r"^\p{L}{3,}\z")), inflected).otherwise(F.array(last))


def searchable(text: Column) -> Column:
    """What facts are looked up in: the text in lower case with each gap between words as one space (loose), and the same with gaps of
    apostrophes and hyphens alone as they are (strict)."""
    lower = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.struct(F.regexp_replace(lower, rf"[^{_LETTER}]+", " ").alias("loose"), F.regexp_replace(lower, rf"['-]*[^{_LETTER}'-][^{_LETTER}]*", " ").alias("strict"))


def holds(text: Column, words: Column) -> Column:
    """Whether a ``searchable`` text holds words in this order, with nothing but signs between them and the last one inflected.

    Signs inside a word must be the same in the text; signs between words may be any. A fact of plain words is a substring of the loose
    text. One with signs in it is one of the strict text, or else, where the loose text has its letters, its places are compared.
    """
    pieces = lambda t: F.regexp_extract_all(t, F.lit(rf"[{_LETTER}]+"), F.lit(0))
    gaps = lambda t: F.regexp_extract_all(F.trim(t), F.lit(rf"[^{_LETTER}]+"), F.lit(0))

    def told(x: Column) -> Column:
        last = F.element_at(x["words"], -1)
        before = F.concat(F.lit(" "), F.array_join(F.slice(x["words"], F.lit(1), F.size(x["words"]) - 1), " "), F.when(F.size(x["words"]) > 1, " ").otherwise(""))
        return T.let(F.struct(before.alias("before"), _forms(last).alias("forms"), x["text"].alias("text")), found)

    def found(x: Column) -> Column:
        text, signs = x["text"], F.regexp_like(F.concat(x["before"], F.element_at(x["forms"], 1)), F.lit("['-]"))
        plain = lambda t: F.regexp_replace(t, "['-]+", " ")
        within = lambda where, change: F.exists(x["forms"], lambda f: F.contains(where, F.concat(change(x["before"]), change(f), F.lit(" "))))
        return F.when(~within(text["loose"], plain), False).otherwise(~signs | within(text["strict"], lambda c: c) | F.exists(x["forms"], lambda f: placed(text["strict"], F.concat(x["before"], f))))

    def placed(strict: Column, fact: Column) -> Column:
        held = F.struct(pieces(strict).alias("t"), F.regexp_extract_all(F.regexp_replace(strict, rf"^[^{_LETTER}]+", ""), F.lit(rf"[^{_LETTER}]+"), F.lit(0)).alias("g"), pieces(fact).alias("f"), gaps(fact).alias("w"))

        def anywhere(x: Column) -> Column:
            n = F.size(x["f"])
            same = lambda i, k: (F.get(x["t"], i + k) == F.get(x["f"], k)) & ((k == n - 1) | (F.get(x["w"], k) == " ") | (F.get(x["w"], k) == F.get(x["g"], i + k)))
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x["t"]) - n, F.lit(0))), lambda i: F.get(x["t"], i) == F.get(x["f"], 0))
            return F.exists(starts, lambda i: F.coalesce(F.forall(F.sequence(F.lit(0), n - 1), lambda k: same(i, k)), F.lit(False)))

        return T.let(held, anywhere)

    return F.when(F.size(words) > 0, T.let(F.struct(words.alias("words"), text.alias("text")), told)).otherwise(False)


def contains_fact(text: Column, fact: Column) -> Column:
    """Whether a text holds a fact's words in order; a fact without words is in none. A null text is the empty one."""
    return holds(searchable(F.coalesce(text, F.lit(""))), fact_words(F.coalesce(fact, F.lit(""))))


def marked(claim: Column) -> Column:
    """What a claim that no source holds rests on, by its words."""
    folded = T.folded(claim)
    return F.when(F.regexp_like(folded, F.lit(EXPERIENCE)), "experience").when(F.regexp_like(folded, F.lit(LOGIC)), "logic").when(F.regexp_like(folded, F.lit(INFERENCE)), "inference").otherwise("unknown")


def with_evidence(pairs: DataFrame) -> DataFrame:
    """``pairs`` (source, candidate) with ``claims``: (start, end, claim, evidence) of the candidate against the source.

    A claim whose words are those of one of the source's claims is told by a hashed difference of both lists, in linear time; only the
    others are searched for in the source, each once through it. Null texts are empty.
    """
    keys = lambda of: F.transform(of, lambda c: F.array_join(fact_words(c["claim"]), " "))

    def judged(x: Column) -> Column:
        """Lists and what the source is searched in are made once, outside of what is done for each claim."""

        def told(c: Column, words: Column) -> Column:
            held = F.when(words == "", False).when(~F.array_contains(x["new"], words), True).otherwise(holds(x["text"], F.split(words, " ")))
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["claim"].alias("claim"), F.when(held, "source").otherwise(marked(c["claim"])).alias("evidence"))

        return F.zip_with(x["claims"], x["keys"], told)

    def compared(x: Column) -> Column:
        return T.let(F.struct(F.array_except(x["keys"], x["known"]).alias("new"), x["keys"].alias("keys"), x["claims"].alias("claims"), x["text"].alias("text")), judged)

    def keyed(x: Column) -> Column:
        return T.let(F.struct(keys(x["claims"]).alias("keys"), keys(x["held"]).alias("known"), x["claims"].alias("claims"), x["text"].alias("text")), compared)

    source, candidate = (F.coalesce(name, F.lit("")) for name in ("source", "candidate"))
    return pairs.withColumn("claims", T.let(F.struct(claims_of(candidate).alias("claims"), claims_of(source).alias("held"), searchable(source).alias("text")), keyed))


def claim_evidence(pairs: DataFrame) -> DataFrame:
    """(pair_id, start_pos, end_pos, claim, evidence) of each candidate's claims."""
    # An outer explode is not preceded by a filter that would work the claims out once more
    told = with_evidence(pairs).select("pair_id", F.explode_outer("claims").alias("c")).where("c IS NOT NULL")
    return told.select("pair_id", F.col("c.start").cast("long").alias("start_pos"), F.col("c.end").cast("long").alias("end_pos"), "c.claim", "c.evidence")


def grounding(pairs: DataFrame) -> DataFrame:
    """Of each pair the number of claims of each class, and whether all rest on the source or on logic, as documentation, release notes
    and presentations must; a candidate without claims is grounded. Nothing is shuffled."""
    count = lambda name: F.size(F.filter("claims", lambda c: c["evidence"] == name)).cast("long").alias(name)
    grounded = F.forall("claims", lambda c: c["evidence"].isin(*GROUNDED))
    return with_evidence(pairs).select("pair_id", F.size("claims").cast("long").alias("claims"), *map(count, CLASSES), grounded.alias("grounded"), F.when(grounded, "keep").otherwise("missing").alias("status"))
