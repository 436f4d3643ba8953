"""Scoring of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of documents that are put into a folder, a bounded number at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def findings_stream(docs: DataFrame) -> DataFrame:
    """Findings need no state: a streaming frame of documents becomes one of findings."""
    return detect.all_findings(docs)


def score_stream(docs: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's scores to a Parquet folder. A batch that is run again writes its own folder anew, so that each
    document is scored once whatever fails."""

    def write(batch: DataFrame, number: int) -> None:
        score.score_documents(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
