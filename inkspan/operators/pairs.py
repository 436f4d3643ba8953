"""Source against candidate: literals, anchors, markers and shape that an edit must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from . import detect

# Literal and anchor patterns, marker terms
LITERALS = {
    "url": r"https?://[^\s<>\"']+",
    "date": r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b",
    "number": r"\b\d+(?:,\d{3})*(?:\.\d+)?%?",
    "quoted": r'"[^"\n]*"|“[^”\n]*”',
    "code": T.CODE,
}
ANCHORS = {
    "negation": r"\b(?:not|no|never|none|nobody|nothing|nowhere|without|neither|nor|isn't|aren't|wasn't|weren't|don't|doesn't|didn't|can't|cannot|won't|wouldn't|couldn't|shouldn't|mustn't|hasn't|haven't|hadn't)\b",
    "polarity": r"\b(?:increase[sd]?|increasing|decrease[sd]?|decreasing|rise|rises|rose|rising|falls?|fell|falling|grows?|grew|growing|shrinks?|shrank|shrinking|reduce[sd]?|reducing|cuts?|cutting|double[sd]?|doubling|improve[sd]?|improving|worsen|worsens|worsened|worsening|positive|negative|more|less|higher|lower|greater|fewer)\b",
    "modality": r"\b(?:may|might|can|could|will|would|shall|should|must|ought|need to|have to|has to)\b",
    "quantifier": r"\b(?:all|some|any|every|each|many|most|few|several|none|both|neither|plenty|at least|at most|no more than|no less than|up to|over|under|more than|less than)\b",
    "causality": r"\b(?:because|therefore|thus|hence|consequently|leads? to|led to|results? in|results? from|caused|causes|causing|cause|so that)\b",
    "condition": r"\b(?:if|unless|provided that|as long as|given that|assuming|whenever)\b",
    "scope": r"\b(?:up to|at most|no more than|at least|no less than|approximately|about|roughly|nearly|more than|less than|over|under|within|exactly)\b",
    "attribution": r"\b[Aa]ccording to\s+[A-Z][A-Za-z0-9']+|\breported by\s+[A-Z][A-Za-z0-9']+|\bper\s+[A-Z][A-Za-z0-9']+|\b[A-Z][A-Za-z0-9']+\s+(?:said|reported|stated|claimed|argued|wrote|noted|highlighted)\b",
    "name": r"\b[A-Z]{2,}(?:[0-9]+)?\b",
}
#: Letters and digits that the matches of a category begin with.
HEADS = {
    "url": "h", "date": "0123456789", "number": "0123456789", "negation": "nwiadcsmh", "polarity": "idrfgscwpnmlh", "modality": "mcwsonh", "quantifier": "asemfnbpuol",
    "causality": "bthclrs", "condition": "iupagw", "scope": "uanrmlowe",
}
MARKERS = {
    "negation": "no not never none nobody nothing nowhere without neither nor can't cannot won't wouldn't don't doesn't didn't isn't aren't wasn't weren't shouldn't couldn't mustn't hasn't haven't hadn't".split(),
    "obligation": ["must", "may", "can", "should", "shall", "required", "requires", "requiring", "needs", "needed", "need to", "have to", "has to", "allowed", "permitted", "mandatory", "optional", "must not"],
    "scope": ["only", "all", "every", "each", "any", "none", "except", "read-only", "full", "restricted", "limited", "exclusive", "up to", "at most", "at least", "no more than", "no less than", "under", "over", "within", "exactly"],
    "temporal_condition": ["if", "unless", "when", "whenever", "before", "after", "until", "provided that", "as long as", "given that", "assuming", "once", "expires", "expired", "expiration", "expiry"],
    "causality": ["because", "caused", "causes", "cause", "causing", "due to", "therefore", "thus", "hence", "consequently", "leads to", "led to", "results in", "results from", "so that", "means"],
    "uncertainty": ["might", "could", "may", "likely", "possibly", "perhaps", "maybe", "probably", "suggests", "suggested", "appears", "appeared", "seems", "seemed", "reportedly", "presumably", "estimated", "claims", "claimed", "not proven", "unverified", "tentatively", "pending"],
    "promise_intensity": ["guarantee", "guaranteed", "ensures", "ensure", "promises", "promise", "always", "seamless", "world-class", "best-in-class", "definitely", "absolutely", "perfect"],
}
#: A deterministic edit, as plain SQL over ``text``, that loses and changes some of what it should keep.
CANDIDATE_SQL = "replace(replace(replace(replace(text, '45%', '46%'), 'must not', 'must'), 'always', 'often'), 'https://a.example.com/p?utm_source=feed&utm_medium=mail', 'https://a.example.com/p')"


def _values(folded: str, parts: str, patterns: dict[str, str], n: int) -> Column:
    """Matches in a folded column, whose offsets are those of the original; values are cut from the ``parts`` of the original."""

    def found(category: str, pattern: str) -> Column:
        spans = F.expr(T.spans_sql(folded, T.beginning(HEADS.get(category, ""), pattern)))
        return F.transform(spans, lambda s: F.struct(F.lit(category).alias("category"), T.taken(F.col(parts), s["start"], s["end"] - s["start"]).alias("value"), F.lit(n).alias("n")))

    return F.flatten(F.array(*[found(category, pattern) for category, pattern in patterns.items()]))


def canonical_value(category: Column, value: Column) -> Column:
    """Numbers without percent signs and commas, dates with dashes, the rest as they are."""
    return F.when(category == "number", F.regexp_replace(value, "[%,]", "")).when(category == "date", F.regexp_replace(value, "[/ ]", "-")).otherwise(value)


def value_counts(pairs: DataFrame, patterns: dict[str, str], outer: bool = False) -> DataFrame:
    """(row, pair_id, category, value, n) of the values that source and candidate of a row hold an unequal number of times.

    Both sides are exploded in one row and counted with one shuffle: a value adds one for the source, takes one for the
    candidate. Equal sides hold all values equally often, so nothing is looked for in them. ``outer``: and a row of nulls for
    each pair without values.
    """
    sides = {"s": "source", "c": "candidate"}
    keyed = pairs.select("pair_id", *[F.coalesce(side, F.lit("")).alias(side) for side in sides.values()], F.monotonically_increasing_id().alias("row"))
    unequal = F.col("source") != F.col("candidate")
    keyed = keyed.withColumns({side: F.when(unequal, F.col(side)).otherwise(F.lit("")) for side in sides.values()}) if outer else keyed.where(unequal)
    # Texts are folded in a step of their own, once for all patterns
    keyed = keyed.select("pair_id", "row", *[T.unmarked(F.col(side)).alias(x) for x, side in sides.items()], *[T.parts(F.col(side)).alias(f"{x}_parts") for x, side in sides.items()])
    keyed = keyed.withColumns({x: T.folded(F.col(x)) for x in sides})
    # Spark puts a test of what is exploded before an inner explode, which would look for all values twice more
    told = keyed.select("pair_id", "row", F.explode_outer(F.concat(_values("s", "s_parts", patterns, 1), _values("c", "c_parts", patterns, -1))).alias("v"))
    sides = told if outer else told.where("v is not null")
    return sides.groupBy("row", "pair_id", "v.category", canonical_value(F.col("v.category"), F.col("v.value")).alias("value")).agg(F.coalesce(F.sum("v.n"), F.lit(0)).alias("n"))


def multiset_changes(pairs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(pair_id, category, value, lost, gained) where source and candidate hold a value an unequal number of times.

    A null side is the empty text. Each row is a pair of its own: rows of one pair_id are told apart.
    """
    counted = value_counts(pairs, patterns).where("n <> 0")
    return counted.select("pair_id", "category", "value", F.greatest("n", F.lit(0)).cast("long").alias("lost"), F.greatest(-F.col("n"), F.lit(0)).cast("long").alias("gained"))


def _present(text: Column, terms: list[str]) -> Column:
    """Which terms a lower-cased text holds as whole words. Plain words are looked up in the set of the text's words; a term
    of several words is matched only in a text that has its longest one."""
    plain = [t for t in terms if rules.words_in(t) == [t]]
    rest = [t for t in terms if t not in plain]
    waited = sorted({*plain, *(max(rules.words_in(t), key=len) for t in rest)})

    def found(held: Column) -> Column:
        longer = [F.when(F.array_contains(held, max(rules.words_in(t), key=len)) & F.regexp_like(text, F.lit(rf"\b{t}\b")), F.lit(t)) for t in rest]
        return F.concat(held, F.filter(F.array(*longer), lambda t: t.isNotNull())) if longer else held

    held = F.array_intersect(F.split(text, "[^a-z0-9_]+"), F.array(*map(F.lit, waited)))
    return F.array_intersect(T.let(held, found), F.array(*map(F.lit, terms)))


def marker_changes(pairs: DataFrame) -> DataFrame:
    """Terms of each marker dimension that only the source (missing) or only the candidate (added) has.

    Sides that are equal cannot differ and are left out first. A null side is the empty text. Each row is told by itself.
    """
    terms = sorted({t for own in MARKERS.values() for t in own})
    unequal = pairs.select("pair_id", *[F.coalesce(side, F.lit("")).alias(side) for side in ("source", "candidate")]).where("source <> candidate")
    sides = unequal.select("pair_id", *[_present(F.lower(T.folded(F.col(side))), terms).alias(x) for side, x in (("source", "s"), ("candidate", "c"))])
    held = lambda side, own: F.filter(F.array(*map(F.lit, own)), lambda t: F.array_contains(F.col(side), t))
    rows = sides.select("pair_id", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), held("s", own).alias("a"), held("c", own).alias("b")) for k, own in MARKERS.items()])).alias("d")).select("pair_id", "d.*")
    told = rows.select("pair_id", "dimension", F.array_join(F.array_except("a", "b"), ",").alias("missing"), F.array_join(F.array_except("b", "a"), ",").alias("added"), F.size("a").cast("long").alias("in_source"))
    return told.where("missing <> '' or added <> ''")


def digests(docs: DataFrame) -> DataFrame:
    """sha256 of each body with LF line ends, and of the record of id and body."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n")
    return docs.select("doc_id", F.sha2(body, 256).alias("body_digest"), F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), body), 256).alias("record_digest"))


def _corrections() -> detect.Detector:
    pattern = r"(?i)\b(?:" + "|".join(sorted(rules.CORRECTIONS, key=len, reverse=True)) + r")\b"
    return detect.Detector("correction", pattern, "code_quotes", "strict", tuple(rules.CORRECTIONS))


def _replacement() -> Column:
    return F.create_map(*[F.lit(x) for pair in rules.CORRECTIONS.items() for x in pair])[F.lower("value")]


def repairs(docs: DataFrame) -> DataFrame:
    """Literal corrections outside code and quotes: (doc_id, original, replacement, start_pos), and how texts read after them.

    A correction applies where the masked text has it, so offsets hold; edits of a text do not overlap.
    """
    return detect.found_in(docs, [_corrections()]).select("doc_id", F.col("value").alias("original"), _replacement().alias("replacement"), "start_pos", "end_pos")


def repaired_text(text: Column) -> tuple[Column, Column]:
    """How many corrections a text has, and the text with them made. The original is cut by the lengths of its masked pieces."""
    d = _corrections()
    table = F.create_map(*[F.lit(x) for pair in rules.CORRECTIONS.items() for x in pair])
    found = T.spans(T.mask_code_and_quotes(T.folded(text)), d.pattern)

    def out(spans: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        parts = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, done: F.concat(F.substring(text, done + 1, s["start"] - done), table[F.lower(s["value"])]))
        return F.struct(F.size(spans).cast("long").alias("edits"), F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text))).alias("fixed"))

    done = T.let(found, out)
    return done["edits"], done["fixed"]


def repaired(docs: DataFrame) -> DataFrame:
    """Texts after their repairs: digest and the change of length, of rows that have any. Each row is mended by itself."""
    likely = docs.where(T.any_in(F.lower("text"), tuple(rules.CORRECTIONS)))
    edits, fixed = repaired_text(F.col("text"))
    told = likely.select("doc_id", "text", edits.alias("edits"), fixed.alias("fixed")).where("edits > 0")
    return told.select("doc_id", "edits", (F.length("fixed") - F.length("text")).cast("long").alias("longer_by"), F.sha2("fixed", 256).alias("fixed_sha256"))
