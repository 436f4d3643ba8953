"""Routing of requests, review statuses, and calibration of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .score import key_of

# Request patterns, in order of precedence; status weights
NON_PROSE = (
    r"\b(?:python|bash|shell|javascript|typescript|rust|go)\b.*\b(?:function|script|code)\b",
    r"\b(?:yaml|json|toml)\b.*\b(?:configuration|config)\b",
    r"\bwhat is \d+\s*[+*/-]\s*\d+\b",
    r"\bwhat is the capital of\b",
    r"\b(?:explain|what is|how does)\b.*\b(?:cve|cvss|api|protocol)\b",
)
AUDIT = (
    r"\baudit\b",
    r"\bdetect\b.*\b(?:patterns?|prose|writing|slop)\b",
    r"\bdoes this pass\b",
    r"\bflag (?:the )?(?:ai |formulaic )?patterns?\b",
    r"\breview\b.*\b(?:ai patterns?|formulaic structure|formulaic writing|slop)\b",
    r"\b(?:score|grade)\b.*\b(?:writing|text|draft|slop)\b",
    r"\bscan\b.*\b(?:draft|text|writing|prose|slop|patterns?)\b",
)
STYLE = (r"\b(?:write|rewrite|edit|polish|phrase|clean)\b", r"\breview\b.*\b(?:abstract|post|email|draft|article|copy)\b")
DETECT_ONLY = r"\b(?:detect|flag only|audit only|scan)\b"
EDIT_FILE = r"\b(?:edit|clean|fix)\b.*\b[\w.-]+\.(?:md|mdx|txt|rst|adoc)\b"
STATUS_WEIGHT = {"no-finding": 0, "keep": 1, "revise": 2, "cut": 3, "ask-author": 4}
#: Requests to seed conversations with, by turn; conversations of the tables hold none.
REQUESTS = ("Please audit my draft", "scan this text for slop", "Rewrite this email", "edit and clean notes.md", "write a python script", "what is the capital of France", "hello there", "")
SEEDED_REQUEST = "CASE conv_id % 8 " + " ".join(f"WHEN {n} THEN text || ' {r}'" for n, r in enumerate(REQUESTS)) + " END"


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?is)(?:" + "|".join(patterns) + ")"


def route(text: Column) -> tuple[Column, Column]:
    """Whether the prose skill is asked for, and its mode: non-prose before audit before style."""
    is_ = lambda *p: F.regexp_like(text, F.lit(any_of(p)))
    mode = F.when(is_(*NON_PROSE), "none").when(is_(*AUDIT), F.when(is_(DETECT_ONLY), "detect").otherwise("audit")).when(is_(*STYLE), F.when(is_(EDIT_FILE), "edit").otherwise("rewrite")).otherwise("none")
    return F.when(mode == "none", "none").otherwise("prose"), mode


def routed(turns: DataFrame) -> DataFrame:
    skill, mode = route(F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", skill.alias("skill"), mode.alias("mode"))


def statuses(findings: DataFrame) -> DataFrame:
    """A review status for each finding: strict ones are cut if severe, else revised; advisory ones ask or are kept."""
    status = F.when((F.col("signal") == "strict") & (F.col("severity") == "high"), "cut").when(F.col("signal") == "strict", "revise").when(F.col("severity") == "high", "ask-author").otherwise("keep")
    return findings.withColumn("status", status)


def decisions(findings: DataFrame) -> DataFrame:
    """Per document, or row where findings carry it, the count of each status and the strongest one."""
    weight = F.create_map(*[F.lit(x) for pair in STATUS_WEIGHT.items() for x in pair])
    rows = statuses(findings).withColumn("w", weight[F.col("status")])
    counts = [F.sum((F.col("status") == s).cast("int")).cast("long").alias(s.replace("-", "_")) for s in STATUS_WEIGHT if s != "no-finding"]
    return rows.groupBy(*dict.fromkeys((key_of(findings), "doc_id"))).agg(*counts, F.max_by("status", "w").alias("decision")).drop("row")


def interventions(findings: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` findings of each document: strict first, then by weight, then in text order."""
    order = Window.partitionBy(key_of(findings)).orderBy((F.col("signal") != "strict").cast("int"), F.col("weight").desc(), "start_pos", "end_pos", "rule_id")
    return findings.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("doc_id", "rank", "rule_id", "start_pos", "end_pos")


def pooled_rates(labelled: DataFrame) -> DataFrame:
    """Recall and false-positive rate of ``flagged`` against ``expected``, overall, by language and by source; null without cases."""
    rows = labelled.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source"))
    n = lambda c: F.sum(c.cast("int")).cast("long")
    told = rows.agg(n(F.col("expected") & F.col("flagged")).alias("hits"), n(F.col("expected")).alias("positives"), n(~F.col("expected") & F.col("flagged")).alias("false_hits"), n(~F.col("expected")).alias("negatives"), F.grouping_id().cast("long").alias("level"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return told.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "hits", "positives", "false_hits", "negatives", rate("hits", "positives").alias("recall"), rate("false_hits", "negatives").alias("false_positive_rate"))


def agreement(labelled: DataFrame) -> DataFrame:
    """Mean absolute error and Spearman's rank correlation of ``score`` and ``target``.

    Rows are counted once, by score and target, and all else comes from these counts: a score has at most 101 values and a
    target few, so no window sees all rows and ``labelled`` is worked out once. Rows without a score or target rank among the
    others and are left out then.
    """
    cells = labelled.groupBy("score", "target").agg(F.count(F.lit(1)).alias("n"))
    for name in ("score", "target"):
        # Doubled ranks are whole: twice what is below, and one more than the rows of equal value
        upto = F.sum("n").over(Window.orderBy(name).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn(f"{name}_rank", 2 * upto - F.sum("n").over(Window.partitionBy(name)) + 1)
    n, x, y = F.col("n").cast("decimal(38,0)"), F.col("score_rank").cast("decimal(20,0)"), F.col("target_rank").cast("decimal(20,0)")
    kept = cells.where("score is not null and target is not null")
    sums = {"documents": F.col("n"), "errors": F.col("n") * F.abs(F.col("score") - F.col("target")), "x": n * x, "y": n * y, "xx": n * x * x, "yy": n * y * y, "xy": n * x * y}
    told = kept.agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    spread = lambda a, b, ab: F.col(ab).cast("double") - F.col(a).cast("double") * F.col(b).cast("double") / F.col("documents")
    apart = F.sqrt(spread("x", "x", "xx")) * F.sqrt(spread("y", "y", "yy"))
    spearman = F.when(apart > 0, spread("x", "y", "xy") / apart)
    return told.select(F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.col("errors") / F.col("documents"), 4).alias("mean_absolute_error"), F.round(spearman, 4).alias("spearman"))
