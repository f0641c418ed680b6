"""DuckDB SQL of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_SQL = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op7_token_rollups": f"""
        WITH d AS (
            SELECT source, lang, {_WORDS} AS words, octet_length(encode(coalesce(text, ''))) AS bytes
            FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
        SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS documents, sum(words)::BIGINT AS tokens
        FROM d GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'bytes-1', count(*)::BIGINT, sum(bytes)::BIGINT FROM d GROUP BY source, lang""",
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT *, sha1(payload) AS hex, row_number() OVER (PARTITION BY payload ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
            CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN first END AS refers_to FROM d""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
