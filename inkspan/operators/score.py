"""From findings to a risk score: overlap groups, primaries, diminishing weights, score, band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from . import detect

PER_WORDS = 500


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and ``row``, a key that each row has for itself: rows of one id stay apart."""
    return docs.select("doc_id", "text", T.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))


def key_of(findings: DataFrame) -> str:
    """What tells the rows of findings apart: their row where they carry it, else their id."""
    return "row" if "row" in findings.columns else "doc_id"


def findings_of(docs: DataFrame, profile: str = "general", outer: bool = False) -> DataFrame:
    """All findings of each row, with ``row`` and ``words``, without their values, which no score asks for."""
    return detect.all_findings(rows_of(docs), profile, ("doc_id", "row", "words"), outer, valued=False)


def registry(spark: SparkSession) -> DataFrame:
    """The rule table: of fixed size, so it may be broadcast."""
    rows = [(r.rule_id, r.category, r.severity, r.review, r.signal, r.detector or None, r.weight, r.ordinal) for r in rules.RULES]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, review string, rule_signal string, detector string, weight int, ordinal int")


def overlap_groups(findings: DataFrame) -> DataFrame:
    """``findings`` with category, severity, weight, island and is_primary.

    Findings that carry ``row`` are grouped by it, others by doc_id. Findings of a document that overlap, in runs of one kind of evidence, form an island. Its primary is strict before
    advisory, then the most severe, then of the longest rule id, then the first.
    """
    rated = findings.join(F.broadcast(registry(findings.sparkSession)), "rule_id", "left")
    rated = rated.withColumns({"category": F.coalesce("category", F.lit("structural")), "severity": F.coalesce("severity", F.lit("medium")), "weight": F.coalesce("weight", F.lit(rules.WEIGHTS["medium"])), "ordinal": F.coalesce("ordinal", F.lit(len(rules.RULES)))})
    key = key_of(findings)
    order = Window.partitionBy(key).orderBy("start_pos", "end_pos", "ordinal", "rule_id")
    rated = rated.withColumn("turn", (F.col("evidence") != F.lag("evidence").over(order)).cast("int"))
    rated = rated.withColumn("kind_run", F.sum(F.coalesce("turn", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "kind_run").orderBy("start_pos", "end_pos", "ordinal", "rule_id")
    reach = F.max("end_pos").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rated = rated.withColumn("opens", F.coalesce((F.col("start_pos") >= reach).cast("int"), F.lit(1)))
    rated = rated.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    best = Window.partitionBy(key, "island").orderBy((F.col("signal") != "strict").cast("int"), severity, F.length("rule_id").desc(), "start_pos", "end_pos", "ordinal", "rule_id")
    return rated.withColumn("is_primary", F.row_number().over(best) == 1).drop("turn", "kind_run", "opens")


def weighed(findings: DataFrame) -> DataFrame:
    """``overlap_groups`` with each finding's deduction: strict primaries of a rule weigh in full, then half, then a quarter
    up to the eighth, then nothing; all else weighs nothing."""
    grouped = overlap_groups(findings)
    counts = F.col("is_primary") & (F.col("signal") == "strict")
    nth = F.row_number().over(Window.partitionBy(key_of(findings), "rule_id", counts).orderBy("start_pos", "end_pos", "ordinal"))
    share = F.when(nth == 1, 1.0).when(nth == 2, 0.5).when(nth <= 8, 0.25).otherwise(0.0)
    return grouped.withColumn("deduction", F.when(counts, F.col("weight") * share).otherwise(0.0))


def band(score: Column) -> Column:
    out = F.when(score >= rules.BANDS[0][0], rules.BANDS[0][1])
    for least, name in rules.BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("unknown")


def score_documents(docs: DataFrame, findings: DataFrame | None = None, profile: str = "general") -> DataFrame:
    """words, findings, primaries, penalty, score, band, density and status of every document.

    The penalty is per 500 words (unscaled without words) and rounds half to even. A document without findings scores 100.
    Each row is scored by its own findings, repeated rows and rows of one id each for themselves, and texts are not
    shuffled. ``findings`` that were found before are joined by doc_id, which must then tell documents apart.
    """
    found = weighed(findings_of(docs, profile, outer=True) if findings is None else findings)
    told = F.col("rule_id").isNotNull()
    summed = found.groupBy(*(["row", "doc_id", "words"] if findings is None else ["doc_id"])).agg(
        F.count("rule_id").alias("n_findings"),
        F.sum((F.col("is_primary") & told).cast("int")).cast("long").alias("n_primary"),
        F.sum((F.col("signal") == "advisory").cast("int")).cast("long").alias("n_advisory"),
        F.sum((F.col("is_primary") & (F.col("signal") == "strict")).cast("int")).cast("long").alias("n_scored"),
        F.sum("deduction").alias("total"),
    )
    joined = summed if findings is None else rows_of(docs).select("doc_id", "words").join(summed, "doc_id", "left")
    joined = joined.na.fill(0, ["n_findings", "n_primary", "n_advisory", "n_scored", "total"])
    penalty = F.when(F.col("words") > 0, F.col("total") * PER_WORDS / F.col("words")).otherwise(F.col("total"))
    score = F.greatest(F.lit(0.0), F.bround(F.lit(100.0) - penalty, 0)).cast("long")
    density = F.when(F.col("words") > 0, F.round(F.col("n_scored") * F.lit(500.0) / F.col("words"), 2)).otherwise(F.lit(0.0))
    status = F.when(F.col("n_advisory") > 0, "manual_review_required").otherwise("complete")
    return joined.select("doc_id", "words", "n_findings", "n_primary", F.round("total", 2).alias("penalty"), score.alias("score"), band(score).alias("band"), density.alias("density"), status.alias("status"))
