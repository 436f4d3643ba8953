"""Seeded documents: each text with a deterministic tail, so that every detector has something to find.

The expression is plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARAGRAPH = "The storage team moved every archive to the northern vault because the southern vault had flooded twice within one winter season"
TAILS = [
    " We utilize a robust plan and delve again to delve deeper. Delving is holistic and agile. ",
    " In order to ship, we leverage synergy and unlock value at the end of the day. It goes without saying that this is best-in-class. Make no mistake. ",
    " The vendor is the best and this results in a dramatic impact that is crucial. ",
    " Adoption stands at 45% this year, with 30 of 40 teams on it and 3x the norm. ",
    " It works — well “mostly” – and 🚀 ships!! Nice ✅ work -- truly; fine; good. ",
    " Dear [Your Name], [INSERT SOURCE URL] and [TODO] see citeturn0search0 and oai_citation at https://x.example.com/?utm_source=chatgpt.com now. ",
    " See [source needed] and https://a.example.com/p?utm_source=feed&utm_medium=mail or https://b.example.com/p?id=3&utm_source=feed plus <thinking>hm</thinking> Lorem ipsum. ",
    "\n# Introduction\nbody one here.\n### Why The Plan Matters Now\nbody two here.\n## Next steps\nmore body. ",
    f"\n\n{_PARAGRAPH}.\n\n{_PARAGRAPH} again.\n\nAn unrelated closing paragraph names three people who kept the records by hand. ",
    "\n1. Alpha step one here\n2. Beta step two here\n3. Gamma step three here\n4. Delta step four here\n5. Omega step five here\n- ✅ done item\n**Term:** an explanation of user-friendly and highly-rated things! ",
    " Moreover, the test was written by us. Moreover, the code was reviewed by them. Moreover, the plan was approved by all. The doors were closed, the lamps were broken, and the keys were hidden. ",
    " Have you ever wondered why? We are proud to be industry-leading. Here it is hype rather than substance that fills page after page of every brochure. Click [learn more](https://c.example.com/x) or [the report](https://c.example.com/y) to boost your reach. ",
    " The pаypal link has a zero​width mark and a soft­hyphen. ",
    " If costs rise, we must not cut more than 5 km because at least all NASA teams said no. According to Gartner 12 companies saw a crucial impact, measured on 2024-03-05 and 5 March 2021. Perhaps it always fails. ",
    " Use `delve` in code and \"robust quotes\" here.\n```\nleverage synergy\n```\nNothing else to see. ",
    " In this article we cover a number of things. Simply put, it is remarkable. I think we should wait, because without it the cost is high. Certainly, a range of teams agree. In conclusion, overall it failed at 10:30 on monday. The best part: it learns fast. Now it runs, and\nthen stops, and it ran, and it sat.\n\nNorthern sailors painted seven wooden boats before winter storms arrived.\n\nCheap rubber gloves protect careful gardeners against thorny rose stems.\n\nLoud market traders weigh ripe orange melons beside marble fountains. ",
    " It was red, white, and blue. We had tea, milk, and bread. She saw cats, dogs, and birds. They read maps, charts, and logs. Ultimately the outage broke a version no longer expected. ",
    "",
]


def _literal(text: str) -> str:
    return " || ".join("'" + part + "'" for part in text.split("\n")).replace("' || '", "' || chr(10) || '")


def seeded_sql(text: str = "text", doc_id: str = "doc_id") -> str:
    branches = " ".join(f"WHEN {n} THEN {text} || {_literal(tail)}" for n, tail in enumerate(TAILS) if tail)
    return f"CASE {doc_id} % {len(TAILS)} {branches} ELSE {text} END"


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores if they are read in fewer parts than there are cores, as a small file of one row group is.

    Larger tables are read in more parts than that and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and seeded text of every document."""
    return spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.expr(seeded_sql()).alias("text"))
