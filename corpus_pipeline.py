"""A training-data pipeline: quality, toxicity, near-duplicates, packing. Each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import packing, quality, simhash, toxicity
from inkspan.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, does not reject."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), quality.learnt_rows())
    return scored.where("predicted = 1").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from the labelled ones among them, does not mark."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), toxicity.learnt_rows())
    return scored.where("predicted = 0").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least id; rows without an id come after the others of a group.

    Rows are told apart by a digest of all their columns, so an id that several texts have keeps no more than its group's
    row; of wholly equal rows one is kept.
    """
    content = F.struct("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text"))
    keyed = docs.select(*COLUMNS, F.sha2(F.to_json(content), 256).alias("row_key"))
    kept = simhash.kept_rows(keyed)
    out = keyed.join(kept.where("n = 1"), "row_key", "left_semi")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return out.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: The stages learn models and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
