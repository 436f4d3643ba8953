"""Queries by name, each with the SQL that tells its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeds import documents, seeded, spread
from ..operators import clarity, corpus, detect, integrity, linkage, pairs, preserve, review, score, stats, substance
from . import edits, evidence, oracle, oracle_clarity, oracle_linkage, oracle_more, oracle_preserve, oracle_stats, oracle_substance

Query = Callable[[SparkSession, str], DataFrame]


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.weighed(score.findings_of(seeded(spark, sf_dir)))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).select("doc_id", "rule_id", "signal", "category", "severity", "start_pos", "end_pos", F.col("island").cast("long").alias("island"), "is_primary", "deduction")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_documents(seeded(spark, sf_dir))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("band").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_findings").alias("findings"), F.min("score").alias("least_score"), F.round(F.avg("score"), 4).alias("mean_score"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighed(spark, sf_dir).groupingSets([[F.col("category"), F.col("severity")], [F.col("category")], []], F.col("category"), F.col("severity"))
    told = rows.agg(F.count(F.lit(1)).alias("findings"), F.sum(F.col("is_primary").cast("int")).cast("long").alias("primaries"), F.countDistinct("doc_id").alias("documents"), F.sum("deduction").alias("deduction"))
    return told.withColumns({"category": F.coalesce("category", F.lit("all")), "severity": F.coalesce("severity", F.lit("all"))})


def _detector(key: str) -> Query:
    return lambda spark, sf_dir: detect.pattern_findings(seeded(spark, sf_dir), [key])


OPERATORS: dict[str, tuple[Query, str | None]] = {
    "registry": (lambda spark, sf_dir: score.registry(spark), oracle.registry_rows()),
    "lexical_findings": (lambda spark, sf_dir: detect.lexical_findings(seeded(spark, sf_dir)), oracle.lexical_findings()),
    "lexical_findings_technical": (lambda spark, sf_dir: detect.lexical_findings(seeded(spark, sf_dir), "technical"), oracle.lexical_findings("technical")),
    "pattern_findings": (lambda spark, sf_dir: detect.pattern_findings(seeded(spark, sf_dir)), oracle.pattern_findings()),
    "measured_findings": (lambda spark, sf_dir: detect.measured_findings(seeded(spark, sf_dir)), oracle.measured_findings()),
    "grouped_findings": (_grouped, oracle.grouped_findings()),
    "risk_score": (_scores, oracle.risk_score()),
    "band_counts": (_bands, oracle.band_counts()),
    "category_rollup": (_rollup, oracle.category_rollup()),
} | {f"detect_{key}": (_detector(key), oracle.pattern_findings([key])) for key in detect.BY_KEY}


def _measure(name: str) -> tuple[Query, str]:
    return (lambda spark, sf_dir: getattr(stats, name)(seeded(spark, sf_dir))), getattr(oracle_stats, name)()


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.passage_density(seeded(spark, sf_dir))


MEASURES = ("rhythm", "openers", "transitions", "passives", "long_sentences", "semicolons", "similar_paragraphs", "headings", "numbered_runs", "stylometrics")
OPERATORS |= {name: _measure(name) for name in MEASURES} | {"passage_density": (_passages, oracle_stats.passage_density())}


def _over_seeded(module, name: str, oracle_name: str = "") -> tuple[Query, str]:
    return (lambda spark, sf_dir: getattr(module, name)(seeded(spark, sf_dir))), getattr(oracle_more, oracle_name or name)()


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded documents against the plain ones, of which a third is missing; one kind is switched off."""
    before = integrity.kind_counts(documents(spark, sf_dir).where("doc_id % 3 <> 1").select("doc_id", "text"))
    enabled = tuple(k for k in integrity.KINDS if k != "homoglyph")
    return integrity.compare_to_baseline(integrity.kind_counts(seeded(spark, sf_dir)), before, enabled)


def seeded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source"), F.expr(pairs.CANDIDATE_SQL).alias("candidate"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shapes(seeded(spark, sf_dir)).select("doc_id", *[F.array_join(s, " ").alias(s) for s in corpus.SLOTS])


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return review.routed(turns.withColumn("text", F.expr(review.SEEDED_REQUEST)))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labelled documents: low quality is expected to score under 95."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    told = score.score_documents(seeded(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi")).select("doc_id", "score").join(documents(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id").join(labels, "doc_id")
    return told.select("lang", "source", "score", (F.col("quality") * 100).alias("target"), (F.col("quality") == 0).alias("expected"), (F.col("score") < 95).alias("flagged"))


OPERATORS |= {
    "integrity_findings": _over_seeded(integrity, "integrity_findings"),
    "edit_defects": _over_seeded(integrity, "edit_defects"),
    "baseline_states": (_baseline, oracle_more.baseline()),
    "tracking_pages": (lambda spark, sf_dir: integrity.tracking_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), oracle_more.tracking_pages()),
    "literal_changes": (lambda spark, sf_dir: pairs.multiset_changes(seeded_pairs(spark, sf_dir), pairs.LITERALS), oracle_more.literal_changes()),
    "anchor_changes": (lambda spark, sf_dir: pairs.multiset_changes(seeded_pairs(spark, sf_dir), pairs.ANCHORS), oracle_more.anchor_changes()),
    "marker_changes": (lambda spark, sf_dir: pairs.marker_changes(seeded_pairs(spark, sf_dir)), oracle_more.marker_changes()),
    "digests": _over_seeded(pairs, "digests"),
    "repairs": _over_seeded(pairs, "repairs"),
    "repaired": _over_seeded(pairs, "repaired"),
    "shapes": (_shapes, oracle_more.shapes()),
    "convergent": _over_seeded(corpus, "convergent"),
    "convergent_members": _over_seeded(corpus, "members", "convergent_members"),
    "routed": (_routed, oracle_more.routed()),
    "decisions": (lambda spark, sf_dir: review.decisions(_weighed(spark, sf_dir)), oracle_more.decisions()),
    "interventions": (lambda spark, sf_dir: review.interventions(_weighed(spark, sf_dir)), oracle_more.interventions()),
    "pooled_rates": (lambda spark, sf_dir: review.pooled_rates(_labelled(spark, sf_dir)), oracle_more.pooled_rates()),
    "agreement": (lambda spark, sf_dir: review.agreement(_labelled(spark, sf_dir)), oracle_more.agreement()),
}


def _substance(name: str) -> tuple[Query, str]:
    return (lambda spark, sf_dir: getattr(substance, name)(seeded(spark, sf_dir))), getattr(oracle_substance, name)()


OPERATORS |= {name: _substance(name) for name in ("dimensions", "venue_features", "paragraph_order", "tricolons", "colon_reveals")} | {"gate": (lambda spark, sf_dir: substance.gate(seeded_pairs(spark, sf_dir)), oracle_substance.gate())}


def _linkage(name: str) -> tuple[Query, str]:
    return (lambda spark, sf_dir: getattr(linkage, name)(seeded(spark, sf_dir))), getattr(oracle_linkage, name)()


OPERATORS |= {name: _linkage(name) for name in ("treadmill_prose", "paragraph_reshuffle")}


def _preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preserve.preservation(seeded(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source"), F.expr(oracle_preserve.REWRITE_SQL).alias("candidate")))


OPERATORS |= {"preservation": (_preserved, oracle_preserve.preservation())}



def _clarity(name: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
        return getattr(clarity, name)(docs.select("doc_id", F.expr(oracle_clarity.TEXT).alias("text"), F.expr(oracle_clarity.MEDIUM).alias("medium")))

    return query, getattr(oracle_clarity, name)()


OPERATORS |= {name: _clarity(name) for name in ("clarity_findings", "clarity_decisions")}

OPERATORS |= edits.OPERATORS | evidence.OPERATORS
