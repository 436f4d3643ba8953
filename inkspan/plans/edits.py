"""Queries of the fidelity, calibration and edit operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, record_digest
from ..functions.seeds import seeded
from ..operators import calibration, fidelity, reshape, score
from . import oracle

#: Labels: where each of some rules is first expected, as plain SQL over the seeded texts; one asks for what no text holds.
_LABELS = (("delve", "delve"), ("robust", "robust"), ("holistic", "holistic"), ("moreover", "Moreover"), ("synergy", "synergy"))
#: Characters of a clean span, of the step between two, and of a delivered chunk.
CLEAN, STEP, CHUNK = 60, 240, 700


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.weighed(score.findings_of(seeded(spark, sf_dir))).select("doc_id", "rule_id", "category", "start_pos", "end_pos", "is_primary")


def _labels_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, rule_id, category, start_pos + {i % 2} AS start_pos, end_pos FROM (SELECT doc_id, 'vocab-{rule}' AS rule_id, 'vocabulary' AS category, CAST(length(split_part(text, '{word}', 1)) AS BIGINT) AS start_pos, CAST(length(split_part(text, '{word}', 1)) + {len(word)} AS BIGINT) AS end_pos FROM seeded WHERE contains(text, '{word}')) AS l{i}" for i, (rule, word) in enumerate(_LABELS))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH seeded AS (SELECT * FROM {{docs}}) {_labels_sql()}", docs=seeded(spark, sf_dir))


_GRID = f"SELECT doc_id, CAST(k AS BIGINT) AS start_pos, CAST(k + {CLEAN} AS BIGINT) AS end_pos"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(STEP))).alias("k")).select("doc_id", F.col("k").cast("long").alias("start_pos"), (F.col("k") + CLEAN).cast("long").alias("end_pos"))


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both sides ask for the findings, which are by far the most work: they are written once
    found = findings(spark, sf_dir).select("doc_id", "rule_id", "category", "start_pos", "end_pos").checkpoint()
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    expected, clean = calibration.expected_findings(_labels(spark, sf_dir), found), calibration.clean_span_hits(_grid(spark, sf_dir), found)
    return calibration.detection_rates(expected.join(langs, "doc_id"), clean.join(langs, "doc_id"), "lang")


_FOUND = f"WITH {oracle.findings_ctes()},\n{oracle.GROUPED},\nlabelled AS ({_labels_sql()}),\ngrid AS ({_GRID} FROM (SELECT doc_id, unnest(range(0, length(text) + 1, {STEP})) AS k FROM seeded))"
_EXPECTED = """SELECT l.doc_id, l.rule_id, l.category, l.start_pos, l.end_pos, count(g.doc_id) > 0 AS found, coalesce(bool_or(g.start_pos = l.start_pos AND g.end_pos = l.end_pos), FALSE) AS exact, count(g.doc_id) = 0 OR bool_or(g.category = l.category) AS category_match
FROM labelled l LEFT JOIN grouped g ON l.doc_id = g.doc_id AND l.rule_id = g.rule_id GROUP BY ALL"""
_CLEAN = """SELECT c.doc_id, c.start_pos, c.end_pos, count(g.doc_id) AS findings, coalesce(array_to_string(list_sort(list_distinct(list(g.rule_id) FILTER (WHERE g.rule_id IS NOT NULL))), ','), '') AS rules, count(g.doc_id) > 0 AS hit
FROM grid c LEFT JOIN grouped g ON c.doc_id = g.doc_id AND c.start_pos < g.end_pos AND g.start_pos < c.end_pos GROUP BY ALL"""
_RATES = f""", e AS ({_EXPECTED}), c AS ({_CLEAN}),
asked AS (SELECT lang, count(*) AS expected, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE exact) AS exact FROM e JOIN documents USING (doc_id) GROUP BY lang),
spans AS (SELECT lang, count(*) AS clean_spans, count(*) FILTER (WHERE hit) AS spans_hit FROM c JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(exact, 0) AS exact, coalesce(clean_spans, 0) AS clean_spans, coalesce(spans_hit, 0) AS spans_hit, round(found / expected, 4) AS recall, round(exact / expected, 4) AS exact_rate, round(spans_hit / clean_spans, 4) AS false_positive_rate
FROM asked FULL JOIN spans USING (lang)"""

#: Edits that move blocks, drop some and add some.
RESHAPED = "CASE doc_id % 4 WHEN 0 THEN substr(text, CAST(floor(length(text) / 2) AS INT) + 1) || chr(10) || substr(text, 1, CAST(floor(length(text) / 2) AS INT)) WHEN 1 THEN 'A new opening.' || chr(10) || text WHEN 2 THEN replace(text, '. ', '.' || chr(10)) ELSE text END"


def _reshaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose sentences are blocks, against the same with their halves swapped, a block added, or blocks cut up."""
    rows = seeded(spark, sf_dir).withColumn("text", F.expr("CASE WHEN doc_id % 4 = 2 THEN text ELSE replace(text, '. ', '.' || chr(10)) END"))
    return rows.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source"), F.expr(RESHAPED).alias("candidate"))


_BLOCKS = "list_filter(list_transform(string_split_regex(%s, '\\n+'), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> '')"
_SHAPE = f"""WITH {oracle.SEEDED}, split AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN text ELSE replace(text, '. ', '.' || chr(10)) END AS text FROM seeded),
lists AS (SELECT doc_id, {_BLOCKS % 'text'} AS s, {_BLOCKS % f'({RESHAPED})'} AS c FROM split),
s AS (SELECT doc_id, b, i, row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS nth FROM (SELECT doc_id, unnest(s) AS b, unnest(range(1, len(s) + 1)) AS i FROM lists)),
c AS (SELECT doc_id, b, i, row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS nth FROM (SELECT doc_id, unnest(c) AS b, unnest(range(1, len(c) + 1)) AS i FROM lists)),
met AS (SELECT doc_id, s.i AS s, c.i AS c FROM s FULL JOIN c USING (doc_id, b, nth)),
placed AS (SELECT doc_id, list(c ORDER BY s) FILTER (WHERE s IS NOT NULL AND c IS NOT NULL) AS p, count(s) AS source_blocks, count(c) AS candidate_blocks, count(*) FILTER (WHERE c IS NULL) AS removed, count(*) FILTER (WHERE s IS NULL) AS added FROM met GROUP BY doc_id),
runs AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE list_max(list_reduce(list_concat([[CAST(1 AS BIGINT)]], list_transform(p[2:], lambda x: [x])), lambda acc, x: list_append(acc, 1 + coalesce(list_max(list_transform(list_filter(range(1, len(acc) + 1), lambda j: p[j] < x[1]), lambda j: acc[j])), 0)))) END AS longest FROM placed),
told AS (SELECT doc_id AS pair_id, source_blocks, candidate_blocks, removed, added, CAST(coalesce(len(p), 0) - longest AS BIGINT) AS moved FROM runs)
SELECT *, removed = 0 AND added = 0 AND moved > 0 AS reordered, removed = 0 AND added = 0 AND moved = 0 AS unchanged FROM told"""


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of strict rules, each replaced by three characters."""
    return findings(spark, sf_dir).where("is_primary").select("doc_id", "start_pos", "end_pos", (3 - (F.col("end_pos") - F.col("start_pos"))).alias("longer_by"))


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the clean spans of a text stand once its primary findings are mended."""
    return reshape.carried(_grid(spark, sf_dir).select("doc_id", F.col("start_pos").alias("pos")), _edits(spark, sf_dir))


def _smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Places alone are asked for, so findings are not weighed
    return reshape.smallest_first(score.findings_of(seeded(spark, sf_dir)).select("doc_id", "start_pos", "end_pos").distinct())


def _mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.mended(seeded(spark, sf_dir)).select("doc_id", "rounds", "edits", "decision", F.sha2("text", 256).alias("text_sha256"))


#: What was delivered: two chunks swapped, one left out, one changed, one with other line ends, or all as they were.
_CHUNKS = f"SELECT doc_id, k AS chunk, substr(text, k * {CHUNK} + 1, {CHUNK}) AS text FROM"
_DELIVERED = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND chunk < 2 AND chunks > 1 THEN 1 - chunk ELSE chunk END AS chunk, CASE WHEN doc_id % 5 = 2 AND chunk = 0 THEN text || '!' WHEN doc_id % 5 = 3 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text
FROM (SELECT *, max(chunk + 1) OVER (PARTITION BY doc_id) AS chunks FROM cut) AS w WHERE NOT (doc_id % 5 = 1 AND chunk = 1)"""


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / CHUNK).cast("int"))))
    cut = spark.sql(f"{_CHUNKS} {{docs}}", docs=docs)
    return reshape.delivery(cut, spark.sql(f"WITH cut AS (SELECT * FROM {{cut}}) {_DELIVERED}", cut=cut))


_LF = "sha256(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'))"
_DELIVERY = f"""WITH {oracle.SEEDED}, cut AS ({_CHUNKS} (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 1, 0) / {CHUNK}) AS BIGINT) + 1)) AS k FROM seeded)),
was AS (SELECT doc_id, chunk, {_LF} AS was FROM cut), now AS (SELECT doc_id, chunk, {_LF} AS now FROM ({_DELIVERED})),
met AS (SELECT doc_id, chunk, was, now, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'extra' WHEN was = now THEN 'kept' WHEN EXISTS (SELECT 1 FROM was w WHERE w.doc_id = m.doc_id AND w.was = m.now) THEN 'swapped' ELSE 'stale' END AS state FROM (SELECT * FROM was FULL JOIN now USING (doc_id, chunk)) m),
told AS (SELECT doc_id, count(was) AS chunks, {', '.join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ('kept', 'stale', 'swapped', 'missing', 'extra'))}, sha256(coalesce(string_agg(was, chr(10) ORDER BY chunk), '')) AS recorded_digest, sha256(coalesce(string_agg(now, chr(10) ORDER BY chunk), '')) AS delivered_digest FROM met GROUP BY doc_id)
SELECT *, CASE WHEN stale + swapped + missing + extra = 0 THEN 'verified' ELSE 'failed' END AS decision FROM told"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seeded text against its edit, its findings being the places to be mended; a share that rose by a point is allowed."""
    from .queries import seeded_pairs

    allowed = seeded(spark, sf_dir).where("doc_id % 36 = 3").select(F.col("doc_id").alias("pair_id"), F.lit("number").alias("category"), F.lit("45").alias("from_value"), F.lit("46").alias("to_value"))
    zones = findings(spark, sf_dir).where("is_primary").withColumnRenamed("doc_id", "pair_id")
    return fidelity.gate(seeded_pairs(spark, sf_dir), zones, allowed, ("vault",))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's record, with a list of its first words nested in it."""
    text = F.coalesce("text", F.lit(""))
    record = F.struct(F.col("source"), F.col("doc_id"), F.struct(F.length(text).alias("chars"), F.slice(F.split(text, " ", -1), 1, 5).alias("begins")).alias("body"), F.col("lang"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", record.alias("record"))
    return rows.select("doc_id", F.length(canonical_json(rows, "record", True)).cast("long").alias("n_chars"), record_digest(rows, "record", "document-1").alias("digest"))


_JSON = """'{"body":{"begins":' || to_json(string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), ' ')[1:5]) || ',"chars":' || length(coalesce(text, '')) || '},"doc_id":' || doc_id || ',"lang":' || coalesce(to_json(lang), 'null') || ',"source":' || coalesce(to_json(source), 'null') || '}'"""


def _of_pairs(operator):
    from .queries import seeded_pairs

    return lambda spark, sf_dir: operator(seeded_pairs(spark, sf_dir))


OPERATORS = {
    "protected_spans": (lambda spark, sf_dir: fidelity.protected_spans(seeded(spark, sf_dir), ("vault",)), None),
    "semantic_anchors": (lambda spark, sf_dir: fidelity.semantic_anchors(seeded(spark, sf_dir)), None),
    "sequence_changes": (lambda spark, sf_dir: _of_pairs(fidelity.sequence_changes)(spark, sf_dir), None),
    "churn": (lambda spark, sf_dir: _of_pairs(fidelity.churn)(spark, sf_dir), None),
    "fidelity_gate": (_gated, None),
    "expected_findings": (lambda spark, sf_dir: calibration.expected_findings(_labels(spark, sf_dir), findings(spark, sf_dir)), f"{_FOUND} {_EXPECTED}"),
    "absent_findings": (lambda spark, sf_dir: calibration.absent_findings(_labels(spark, sf_dir), findings(spark, sf_dir)), f"{_FOUND} SELECT l.doc_id, l.rule_id, EXISTS (SELECT 1 FROM grouped g WHERE g.doc_id = l.doc_id AND g.rule_id = l.rule_id AND g.is_primary) AS present FROM labelled l"),
    "clean_span_hits": (lambda spark, sf_dir: calibration.clean_span_hits(_grid(spark, sf_dir), findings(spark, sf_dir)), f"{_FOUND} {_CLEAN}"),
    "detection_rates": (_by_lang, _FOUND + _RATES),
    "block_shape": (lambda spark, sf_dir: reshape.block_shape(_reshaped(spark, sf_dir)), _SHAPE),
    "smallest_spans": (_smallest, None),
    "carried_offsets": (_carried, f"{_FOUND} SELECT c.doc_id, c.start_pos AS pos, CAST(c.start_pos + coalesce(sum(3 - (g.end_pos - g.start_pos)), 0) AS BIGINT) AS candidate_pos FROM grid c LEFT JOIN grouped g ON g.doc_id = c.doc_id AND g.is_primary AND g.end_pos <= c.start_pos GROUP BY c.doc_id, c.start_pos"),
    "mended": (_mended, None),
    "delivery": (_delivered, _DELIVERY),
    "record_digests": (_records, f"""SELECT doc_id, CAST(length({_JSON}) AS BIGINT) AS n_chars, sha256('{{"record":' || {_JSON} || ',"schema":"document-1"}}') AS digest FROM documents"""),
}
