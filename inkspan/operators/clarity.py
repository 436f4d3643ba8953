"""Clarity review: each finding of a text gets one status, which the medium of the text may relax.

A review edits nothing. What only the author can supply becomes a question. One pass over the texts finds what the scorer finds,
claims of importance, impact, causality and superiority with and without evidence beside them, examples and significance without
content, headings that their first line restates, and quotations. From then on rows are findings, shuffled once by their row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detect, score
from . import measured as M
from .detect import Detector
from .review import STATUS_WEIGHT

# Mediums, what each relaxes, rules whose passages are cut, patterns of author gaps, questions
MEDIUMS = ("argument", "explanation", "evocation", "narrative", "guide", "reference", "message")
MEDIUM_RELAX = {
    "evocation": ("struct-antithesis", "struct-balanced-take", "struct-all-same-length", "mechanism-importance", "mechanism-impact", "mechanism-superiority"),
    "narrative": ("struct-antithesis", "struct-all-same-length", "mechanism-causality"),
    "reference": ("struct-fragmented-headers", "struct-template-headings"),
    "guide": ("struct-fragmented-headers", "struct-listicle-trenchcoat", "struct-template-headings"),
    "explanation": ("struct-template-headings",),
}
CUT_RULES = """phrase-worth-noting phrase-at-core phrase-dive-in phrase-transition-glue phrase-complexity-signal
phrase-discovery-narration phrase-in-conclusion phrase-let-sink-in phrase-make-no-mistake phrase-let-me-clear
phrase-heres-thing phrase-hint-plot-spoiler phrase-think-about-it filler-in-order filler-due-to-fact filler-at-point-in-time
filler-system-ability filler-important-note filler-crucial filler-padding-adverbs chatbot-hope-helps chatbot-let-me-know
chatbot-great-question chatbot-certainly-absolutely chatbot-cutoff-disclaimers struct-announce-structure struct-transition-glue
struct-complexity-signalling struct-discovery-narration struct-wisdom-sandwich struct-punchy-closure struct-ending-cliches
struct-synonym-cycling struct-rule-of-three struct-bullet-crutch struct-listicle-trenchcoat struct-catalog-prose
struct-system-tour struct-triplet-overlap fmt-emoji-bullets""".split()
CUT_CATEGORIES = ("filler", "chatbot")
SUBJECTS = "client customer team company vendor startup organization package incident deployment release project meeting user developer product".split()
VAGUE_EXAMPLE = rf"(?i)\b(?:a|one|some|several|many)\s+(?:{'|'.join(SUBJECTS)})\b[^.\n]{{0,80}}?\b(?:once|caused|had|experienced|saw|suffered|faced|reported|learned|taught|happened)\b"
EMPTY_SIGNIFICANCE = r"(?i)\b(?:this|it|that)\s+(?:matters|is important|is significant|is crucial|is the key|underscores|highlights)\b|\bthe stakes are high\b|\beverything is connected\b|\bthis\s+(?:taught|shows?|proves?|means)\b"
HEADING = r"(?m)^#{1,6}\s+[^\n]+$"
QUESTIONS = {
    "vague_example": "[TK: which subject? what happened, and how was it caught or measured?]",
    "empty_significance": "[TK: what specifically changed or matters, and to whom?]",
    "claim_importance": "[TK: what is the mechanism, and what evidence supports this significance?]",
    "claim_impact": "[TK: what is the measured result or limit behind this impact?]",
    "claim_causality": "[TK: what is the cause, and what measured result supports it?]",
    "claim_superiority": "[TK: what is the basis of comparison or the measured result?]",
    "struct-unsourced-precision": "[TK: what is the source for this figure?]",
}
#: Characters that a finding of no length of its own counts as, where overlaps are asked for.
DEFAULT_LENGTH = 6
UNKNOWN_MEDIUM = "unknown-medium"

#: Finders of the review's own, by their key: the kind of entry, and the rule that it is reported under.
_CLAIMS = {key: detect.BY_KEY[f"mechanism_{key}"]._replace(mask="") for key in detect.SIGNALS}
OWN = {
    "vague_example": ("gap", "struct-specificity-theater"),
    "empty_significance": ("gap", "struct-empty-declaratives"),
    "fragmented_header": ("header", "struct-fragmented-headers"),
    "quotation": ("quotation", ""),
} | {f"claim_{k}": ("claim", f"mechanism-{k}") for k in _CLAIMS} | {f"bare_{k}": ("bare", f"mechanism-{k}") for k in _CLAIMS}
FINDERS = [
    Detector("vague_example", VAGUE_EXAMPLE, words=tuple(SUBJECTS)),
    Detector("empty_significance", EMPTY_SIGNIFICANCE, words=("this", "it", "that", "stakes", "everything")),
    Detector("fragmented_header", HEADING, needles=("#",), restated=True),
    Detector("quotation", r""""[^"\n]*"|'[^'\n]*'|“[^”\n]*”|‘[^’\n]*’|`[^`\n]*`""", needles=('"', "'", "“", "‘", "`")),
    *(d._replace(key=f"claim_{k}", excuse="", around=0, actors=False) for k, d in _CLAIMS.items()),
    *(d._replace(key=f"bare_{k}") for k, d in _CLAIMS.items()),
]


def scorer_finders(profile: str = "general") -> list[Detector]:
    """What the scorer looks for, without the claims, which a review judges itself."""
    return detect.lexical(profile) + [d for d in detect.patterns_of(profile) if not d.key.startswith("mechanism_")]


def _of(name: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def _touches(kind: str) -> Column:
    """Whether a finding shares a character with one of another kind: one that begins no later and ends after its start, or one that
    begins no earlier and before its end. Running bounds tell both, so the work of a text is that of sorting its findings."""
    rows = Window.partitionBy("row")
    upto = rows.orderBy("start_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = rows.orderBy(F.col("start_pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of = F.col("kind") == kind
    met = (F.max(F.when(of, F.col("reach"))).over(upto) > F.col("start_pos")) | (F.min(F.when(of, F.col("start_pos"))).over(onward) < F.col("reach"))
    return F.coalesce(met, F.lit(False))


def _entries(docs: DataFrame, profile: str) -> DataFrame:
    """All entries of a review with their status, by ``row``; a row without any has one of nulls. Takes doc_id, text and medium."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "medium", F.monotonically_increasing_id().alias("row"))
    found = detect.found_in(rows, scorer_finders(profile) + FINDERS, ("doc_id", "medium", "row"), outer=True, measures=tuple(M.MEASURES))
    name = F.col("rule_id")
    kind = F.coalesce(_of(name, {key: k for key, (k, _) in OWN.items()}), F.when(name.isNotNull(), "scored"))
    reach = F.when(F.col("evidence") == "document", F.col("start_pos") + DEFAULT_LENGTH).otherwise(F.col("end_pos"))
    place = Window.partitionBy("row", F.regexp_replace("rule_id", "^(?:claim|bare)_", ""), "start_pos", "end_pos")
    known = found.withColumns({"kind": kind, "reach": reach})
    known = known.withColumns({"quoted": _touches("quotation"), "covered": _touches("scored"), "bare": F.max((F.col("kind") == "bare").cast("int")).over(place) == 1})
    known = known.where("kind IS NULL OR NOT (kind IN ('quotation', 'bare') OR (kind = 'gap' AND covered))")
    # Dashes are absolute: beside what the scorer makes of one stands a finding that neither quotation nor medium excuses
    known = known.withColumn("kind", F.explode(F.when(name == "fmt-em-dash", F.array(F.lit("scored"), F.lit("dash"))).otherwise(F.array("kind"))))
    rated = known.join(F.broadcast(score.registry(docs.sparkSession).select("rule_id", "category", "review")), "rule_id", "left")
    reported, medium = F.coalesce(_of(name, {key: rule for key, (_, rule) in OWN.items()}), name), F.col("medium")
    relaxed = F.lit(False)
    for m, rules in MEDIUM_RELAX.items():
        relaxed = F.when(medium == m, reported.isin(*rules)).otherwise(relaxed)
    scored = (
        F.when(name == "struct-unsourced-precision", "ask-author")
        .when(F.col("category").isNull(), "revise")
        .when(F.col("quoted"), "keep")
        .when(name.isin(*CUT_RULES) | F.col("category").isin(*CUT_CATEGORIES), "cut")
        .when((F.col("review") != "deterministic") & relaxed, "keep")
        .otherwise("revise")
    )
    status = (
        F.when(F.col("kind") == "scored", scored)
        .when(F.col("kind") == "claim", F.when(medium.isin("evocation", "narrative") | ~F.col("bare"), "keep").otherwise("ask-author"))
        .when(F.col("kind") == "gap", "ask-author")
        .when(F.col("kind") == "header", F.when(medium.isin("reference", "guide"), "keep").otherwise("revise"))
        .when(F.col("kind") == "dash", "revise")
    )
    told = rated.withColumns({"status": status, "rule": reported})
    return told.select("row", "doc_id", "medium", F.col("rule").alias("rule_id"), "kind", "status", "start_pos", "end_pos", F.when(F.col("status") == "ask-author", _of(name, QUESTIONS)).alias("question"))


def _known(docs: DataFrame) -> Column:
    return F.coalesce(F.col("medium").isin(*MEDIUMS), F.lit(False))


def clarity_findings(docs: DataFrame, profile: str = "general") -> DataFrame:
    """Findings of ``docs`` (doc_id, text, medium) with kind, status, place and, where the author is asked, the question.

    Kinds: scored (what the scorer finds, but for claims), dash, claim, gap, header. A text that is null or empty has no finding; rows
    whose medium is null or unknown are not reviewed.
    """
    return _entries(docs.where(_known(docs)), profile).where("kind IS NOT NULL").drop("row")


def clarity_decisions(docs: DataFrame, profile: str = "general") -> DataFrame:
    """Of each row of ``docs`` the count of each status, of questions, and the decision: the strongest status, or no-finding.

    Rows whose medium is null or unknown get the decision unknown-medium and no counts other than zero.
    """
    counted = {s: F.count(F.when(F.col("status") == s, 1)) for s in STATUS_WEIGHT if s != "no-finding"}
    strongest = F.lit("no-finding")
    for s in sorted(counted, key=STATUS_WEIGHT.get):
        strongest = F.when(F.col(s.replace("-", "_")) > 0, s).otherwise(strongest)
    columns = [c.alias(s.replace("-", "_")) for s, c in counted.items()]
    judged = _entries(docs.where(_known(docs)), profile).groupBy("row", "doc_id", "medium").agg(*columns, F.count("question").alias("questions")).withColumn("decision", strongest).drop("row")
    zeros = [F.lit(0).cast("long").alias(name) for name in judged.columns if name not in ("doc_id", "medium", "decision")]
    return judged.unionByName(docs.where(~_known(docs)).select("doc_id", "medium", *zeros, F.lit(UNKNOWN_MEDIUM).alias("decision")))
