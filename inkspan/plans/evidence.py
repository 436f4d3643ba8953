"""Queries of regions, Chinese findings and claims over the given tables.

None has SQL: regions look behind, and facts are told by rules that SQL takes too long for. Their tests compare them with slow
counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeds import seeded, seeded_sql, spread
from ..operators import claims, locale
from ..operators import pairs as P

#: Chinese prose and Markdown blocks that are put after the texts.
_ZH = "CASE doc_id % 4 WHEN 0 THEN repeat('这是好的,对吗?使用Spark处理`中,文`数据。我们进行了测试,他被大家所喜爱。在开发的过程中出错,这一现象很多。', 1 + CAST(floor(length(text) / 256) AS INT)) WHEN 1 THEN chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '> see [x](http://a.b/c)' || chr(10) || '$ os.path now' || chr(10) || '    y = snake_case' ELSE '' END"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded texts with blocks after them; one in four gets as much Chinese as makes its locale active."""
    return seeded(spark, sf_dir).select("doc_id", F.expr(f"text || {_ZH}").alias("text"))


#: Claims of a candidate that its source does not hold, one of each class, beside what the edit of the pair changes.
_NEW = "CASE doc_id % 5 WHEN 0 THEN ' We saw it fail. It may rain on version 1.2 of a.b!' WHEN 1 THEN ' Therefore the vault held。今天很好！' WHEN 2 THEN ' Nothing else is known?' ELSE '' END"
_CANDIDATE = f"({P.CANDIDATE_SQL}) || {_NEW}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.expr(seeded_sql()).alias("text"))
    return docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source"), F.expr(_CANDIDATE).alias("candidate"))


OPERATORS = {
    "repair_regions": (lambda spark, sf_dir: locale.repair_regions(_marked(spark, sf_dir), ("vault",)), None),
    "technical_spans": (lambda spark, sf_dir: locale.technical_spans(_marked(spark, sf_dir), ("vault",)), None),
    "zh_cn_findings": (lambda spark, sf_dir: locale.zh_cn_findings(_marked(spark, sf_dir)), None),
    "claim_evidence": (lambda spark, sf_dir: claims.claim_evidence(_pairs(spark, sf_dir)), None),
    "grounding": (lambda spark, sf_dir: claims.grounding(_pairs(spark, sf_dir)), None),
}
