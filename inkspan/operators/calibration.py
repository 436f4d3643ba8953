"""Findings against labels: expected and absent findings, clean spans that findings land on, and pooled rates.

Spans meet in an interval join by bins: each span is sent to the bins it reaches, and a pair counts in the first bin that both
reach. So a document with very many spans is spread over its bins, and no two of its spans meet that are far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin. A span reaches as many bins as its length asks for, so bins are wide beside a finding.
BIN = 512


def _bin(place: Column, width: int) -> Column:
    return F.floor(place / width).cast("long")


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = BIN) -> DataFrame:
    """Pairs of a ``left`` and a ``right`` span (key, start_pos, end_pos) of one document that share a character.

    The right one's places are named right_start and right_end; other columns must differ in name. Spans that are empty or null
    overlap nothing, and rows without a key meet none.
    """
    reach = lambda rows: rows.where("start_pos < end_pos").withColumn("bin", F.explode(F.sequence(_bin(F.col("start_pos"), width), _bin(F.col("end_pos") - 1, width))))
    other = reach(right).withColumnsRenamed({"start_pos": "right_start", "end_pos": "right_end"})
    met = reach(left).join(other, [key, "bin"])
    first = F.greatest(_bin(F.col("start_pos"), width), _bin(F.col("right_start"), width))
    return met.where((F.col("start_pos") < F.col("right_end")) & (F.col("right_start") < F.col("end_pos")) & (F.col("bin") == first)).drop("bin")


def expected_findings(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """``labels`` (doc_id, rule_id, category, start_pos, end_pos) with found, exact and category_match.

    found: the rule has a finding in the document; exact: one at the very place; category_match: one of the label's category, or
    none at all. Findings are told once by rule, with all their places, before they meet labels: so many of one rule make no pairs, and
    ``findings`` are worked out once.
    """
    place = lambda a, b: F.struct(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    of_rule = findings.groupBy("doc_id", "rule_id").agg(F.collect_set("category").alias("categories"), F.collect_set(place("start_pos", "end_pos")).alias("places"))
    placed = F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    told = labels.join(of_rule, ["doc_id", "rule_id"], "left").withColumn("exact", placed & F.array_contains("places", place("start_pos", "end_pos")))
    found = F.col("categories").isNotNull()
    return told.select("doc_id", "rule_id", "category", "start_pos", "end_pos", found.alias("found"), F.coalesce("exact", F.lit(False)).alias("exact"), (~found | F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False))).alias("category_match"))


def absent_findings(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """``labels`` (doc_id, rule_id) of rules that must have no primary finding, with ``present``."""
    held = findings.where("is_primary").select("doc_id", "rule_id").distinct().withColumn("present", F.lit(True))
    return labels.select("doc_id", "rule_id").join(held, ["doc_id", "rule_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def clean_span_hits(spans: DataFrame, findings: DataFrame, width: int = BIN) -> DataFrame:
    """``spans`` (doc_id, start_pos, end_pos) that should be clean, with how many findings land on each and of which rules."""
    keyed = spans.select("doc_id", "start_pos", "end_pos").distinct()
    landed = overlapping(keyed, findings.select("doc_id", "rule_id", "start_pos", "end_pos"), width=width)
    counted = landed.groupBy("doc_id", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("findings"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    told = keyed.join(counted, ["doc_id", "start_pos", "end_pos"], "left")
    return told.select("doc_id", "start_pos", "end_pos", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("rules", F.lit("")).alias("rules"), F.col("findings").isNotNull().alias("hit"))


def detection_rates(expected: DataFrame, clean: DataFrame, by: str) -> DataFrame:
    """Pooled recall, exact agreement and share of clean spans hit, by a column of both; null where nothing was asked."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    count = lambda held: F.sum(F.col(held).cast("long"))
    asked = expected.groupBy(by).agg(F.count(F.lit(1)).alias("expected"), count("found").alias("found"), count("exact").alias("exact"))
    spans = clean.groupBy(by).agg(F.count(F.lit(1)).alias("clean_spans"), count("hit").alias("spans_hit"))
    both = asked.join(spans, by, "full").fillna(0, ["expected", "found", "exact", "clean_spans", "spans_hit"])
    return both.withColumns({"recall": rate("found", "expected"), "exact_rate": rate("exact", "expected"), "false_positive_rate": rate("spans_hit", "clean_spans")})
