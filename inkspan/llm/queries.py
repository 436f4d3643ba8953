"""The queries of this subpackage, by name, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from . import divergence, mixing
from .byte_bpe import op7_byte_bpe
from .embeddings import op1_embedding_dedup
from .fingerprint import op2_fingerprint
from .html_text import op9_html_text
from .packing import op3_packing
from .quality import op8_quality
from .runs import op11_periodic_runs
from .sharding import op5_sharding
from .simhash import op6_simhash
from .toxicity import op4_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_fingerprint": op2_fingerprint,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_divergence": divergence.op12_divergence,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE held AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS n
            FROM embeddings
        ), good AS (
            SELECT * FROM held
            WHERE vec_id IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.n AS a, b.n AS b, b.vec_id AS id_b FROM good a JOIN good b ON a.n <> b.n AND len(a.v) = len(b.v)
            WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.95
        ), reached(n, c) AS (
            SELECT n, vec_id FROM good UNION SELECT l.a, r.c FROM reached r JOIN links l ON l.b = r.n
        ), least AS (
            SELECT n, min(c) AS c FROM reached GROUP BY n
        ), counted AS (
            SELECT a AS n, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), FALSE) AS kept
        FROM held LEFT JOIN least USING (n) LEFT JOIN counted USING (n)
    """,
    "op5_sharding": """
        SELECT doc_id, source, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents
    """,
    "op10_warc": """
        WITH held AS (
            SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), placed AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept
            FROM held
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
        FROM placed
    """,
    "op12_divergence": divergence.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
