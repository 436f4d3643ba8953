"""Sources of documents and sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a text that is taken in; longer ones, and blank ones, are set aside.
MOST_CHARS = 1_000_000


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (a hash of the file's address), path and text of whole text files."""
    read = spark.read.text(list(paths), wholetext=True).withColumn("path", F.input_file_name())
    return read.select(F.xxhash64("path").alias("doc_id"), "path", F.col("value").alias("text"))


def json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id and text of JSON files, one object or a list of them each; what is no such object has nulls."""
    return spark.read.schema("doc_id long, text string").option("multiLine", True).json(list(paths))


def admitted(docs: DataFrame, most_chars: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Documents that are taken in, and those that are not with the reason: null, blank or too long."""
    reason = F.when(F.col("text").isNull(), "null").when(F.btrim("text", F.lit(" \t\n\r")) == "", "blank").when(F.length("text") > most_chars, "too long")
    marked = docs.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("doc_id", F.length("text").alias("n_chars"), "reason")


def write_report(report: DataFrame, path: str, kind: str, version: int = 1) -> None:
    """One JSON object a row, with the interface's name and version. The file sink commits whole jobs."""
    report.select(F.lit(kind).alias("interface"), F.lit(version).alias("version"), F.struct("*").alias("row")).write.mode("overwrite").json(path)
