"""DuckDB equivalents of the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_HALF = "CASE WHEN {x} = 0 THEN 0.0 WHEN abs({x}) >= 65520 THEN sign({x}) * CAST('inf' AS DOUBLE) ELSE sign({x}) * round_even(abs({x}) / pow(2, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({x}))), -14) - 10) END + 0.0"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q)"
_TOP = f"SELECT vec_id, {_COS} AS s FROM embeddings e, {_Q} ORDER BY s DESC, vec_id LIMIT 10"
_SCALED = "SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) * [1.0, pow(2, -20), pow(2, 19)][vec_id % 3 + 1] AS x FROM embeddings"
_SUFFIXES = "['.pdf', '.DOCX', '.xlsx', '.Xml', '.pages', '.KEY', '.txt', '', '.numbers', '.iwa', '.tar.GZ']"
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = ("regexp_replace({x}, '^W+|W+$', '', 'g')").replace("W", _WHITE.replace("{", "{{").replace("}", "}}"))
_PLAIN = "SELECT conv_id, turn, translate(text, '.!?;,' || chr(10) || chr(13) || chr(9), '') AS text FROM conversations"
_KEPT = "list_transform(range(1, len(string_split({t}, {s})) + 1), lambda k: string_split({t}, {s})[k] || CASE WHEN k < len(string_split({t}, {s})) THEN {s} ELSE '' END)"


def _pieces(t: str, s: str, keep: bool) -> str:
    """Pieces of column t at the literal s."""
    if keep:
        return f"list_filter({_KEPT.format(t=t, s=s)}, lambda p: p <> '')"
    return f"list_filter(string_split({t}, {s}), lambda p: p <> '')"


def _numbered(key: str, pieces: str, table: str) -> str:
    return f"SELECT {key}, CAST(unnest(range(0, len(p))) AS INTEGER) AS i, unnest(p) AS piece FROM (SELECT {key}, {pieces} AS p FROM {table})"


_TAIL = "list_slice(buf, list_filter(range(1, len(buf) + 2), lambda j: coalesce(list_sum(list_transform(list_slice(buf, j, len(buf)), lambda x: length(x))), 0) <= 20)[1], len(buf))"

#: conv_id, turn, chunk_index, content, total: greedy chunks of 120 characters with an overlap of 20, one piece a step.
_WORDS = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {_pieces("text", "' '", True)} AS p FROM ({_PLAIN})),
g AS (
  SELECT conv_id, turn, 0 AS k, CAST([] AS VARCHAR[]) AS buf, CAST(NULL AS VARCHAR) AS chunk, p FROM t
  UNION ALL
  SELECT conv_id, turn, k + 1,
    CASE WHEN k = len(p) THEN [] WHEN coalesce(list_sum(list_transform(buf, lambda x: length(x))), 0) + length(p[k + 1]) > 120 THEN list_append({_TAIL}, p[k + 1]) ELSE list_append(buf, p[k + 1]) END,
    CASE WHEN k = len(p) OR coalesce(list_sum(list_transform(buf, lambda x: length(x))), 0) + length(p[k + 1]) > 120 THEN array_to_string(buf, '') END, p
  FROM g WHERE k <= len(p)
),
c AS (SELECT conv_id, turn, k, {_STRIP.format(x="chunk")} AS content FROM g WHERE chunk IS NOT NULL),
n AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INTEGER) AS chunk_index, content, CAST(count(*) OVER (PARTITION BY conv_id, turn) AS INTEGER) AS total FROM c WHERE content <> '')
"""

#: The same for turns that a Word file strips.
_TURNS = _WORDS.replace(f"FROM ({_PLAIN})", f"FROM (SELECT conv_id, turn, {_STRIP.format(x='text')} AS text FROM ({_PLAIN}))")

_FORCED = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, text, string_split(text, ' ') AS p FROM ({_PLAIN})),
g AS (
  SELECT conv_id, turn, 0 AS k, CAST([] AS VARCHAR[]) AS buf, 0 AS total, CAST(NULL AS VARCHAR) AS chunk, p FROM t WHERE length(text) > 120
  UNION ALL
  SELECT conv_id, turn, k + 1, nb, CASE WHEN over THEN CAST(list_sum(list_transform(nb, lambda x: length(x))) AS INTEGER) + len(nb) - 1 ELSE total + coalesce(length(w), 0) + 1 END,
    CASE WHEN (over OR k = len(p)) AND len(buf) > 0 THEN array_to_string(buf, ' ') END, p
  FROM (SELECT *, CASE WHEN over THEN list_append(list_slice(buf, greatest(1, len(buf) - 1), len(buf)), w) ELSE list_append(buf, w) END AS nb
        FROM (SELECT *, p[k + 1] AS w, coalesce(total + length(p[k + 1]) + 1 > 120, false) AS over FROM g WHERE k <= len(p)))
),
c AS (SELECT conv_id, turn, k, {_STRIP.format(x="chunk")} AS content FROM g WHERE chunk IS NOT NULL UNION ALL SELECT conv_id, turn, 0, {_STRIP.format(x="text")} FROM t WHERE length(text) <= 120)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INTEGER) AS chunk_index, content FROM c WHERE content <> ''
"""

_STORED = "(SELECT p_brand || '-' || p_size AS id, p_name AS text, p_partkey AS seq FROM part)"

SQL = {
    "search_topk": f"SELECT vec_id, round(s, 6) + 0.0 AS score FROM ({_TOP})",
    "search_scores": f"SELECT vec_id, round({_COS}, 6) + 0.0 AS score FROM embeddings e, {_Q}",
    "ann_recall": "SELECT count(*) AS n_queries, CAST(sum(least(10, n)) AS BIGINT) AS wanted, true AS enough FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 100 = 0",
    "search_multi_query": "SELECT query_id, rank, vec_id, round(s, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5",
    "search_limit_then_lookup": f"SELECT doc_id AS id, text, round(s, 6) + 0.0 AS score FROM ({_TOP}) JOIN documents ON doc_id = vec_id WHERE doc_id % 3 <> 1",
    "search_zero_query": "SELECT vec_id, CAST(0 AS DOUBLE) AS score FROM embeddings WHERE false",
    "search_zero_vectors": f"SELECT vec_id, round(s, 6) + 0.0 AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings e, {_Q} WHERE vec_id % 4 <> 0 ORDER BY s DESC, vec_id LIMIT 10)",
    "half_round": f"SELECT vec_id, CAST(i AS INTEGER) AS i, {_HALF.format(x='x')} AS h FROM ({_SCALED})",
    "half_pack_roundtrip": f"SELECT vec_id, CAST(i AS INTEGER) AS i, {_HALF.format(x='x')} AS h FROM ({_SCALED})",
    "l2_normalize": "SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / greatest(n, 1e-12), 6) + 0.0 AS x FROM (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda y: CAST(CAST(y AS DOUBLE) * (vec_id % 5) AS DOUBLE)) AS v FROM embeddings))",
    "mean_pool": "SELECT label, CAST(i AS INTEGER) AS i, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS m FROM embeddings) GROUP BY label, i",
    "embed_hash": f"""WITH w AS (SELECT p_partkey, md5(w) AS h FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> ''),
b AS (SELECT p_partkey, CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) % 384 AS INTEGER) AS i, CAST(sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM w GROUP BY ALL),
n AS (SELECT p_partkey, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 1e-12) AS x FROM b)
SELECT p_partkey, i, {_HALF.format(x="x")} AS x FROM n WHERE x <> 0""",
    "batch_assign": "SELECT count(*) AS n, CAST(least(count(*), 32) AS INTEGER) AS largest, CAST(0 AS BIGINT) AS rest FROM part",
    "embed_counters": "SELECT count(*) AS total_embeddings, CAST(384 AS INTEGER) AS dimension, true AS timed FROM part",
    "latency_average": "SELECT round(sum(value / (event_id % 32 + 1)) / count(*), 6) + 0.0 AS latency_ms FROM events",
    "route_formats": f"""WITH p AS (SELECT doc_id, 'f' || doc_id AS base, {_SUFFIXES}[doc_id % 11 + 1] AS e FROM documents),
s AS (SELECT doc_id, CASE e WHEN '.tar.GZ' THEN base || '.tar' ELSE base END AS stem, lower(CASE e WHEN '.tar.GZ' THEN '.GZ' ELSE e END) AS suffix FROM p)
SELECT doc_id, suffix, stem, CASE suffix WHEN '.iwa' THEN 'iWork format - use PDF export (Strategy B)' WHEN '.pages' THEN 'Pages - use PDF export' WHEN '.numbers' THEN 'Numbers - use PDF export' WHEN '.key' THEN 'Keynote - use PDF export'
WHEN '.pdf' THEN NULL WHEN '.docx' THEN NULL WHEN '.xlsx' THEN NULL WHEN '.xml' THEN NULL ELSE 'Unsupported format: ' || suffix || '. Supported: [''.pdf'', ''.docx'', ''.xlsx'', ''.xml'']' END AS error FROM s""",
    "xml_records": "SELECT user_id, string_agg(event_type || ': ' || event_id || CASE WHEN event_id % 2 = 0 THEN ' u' ELSE '' END || ' (' || strftime(ts, '%Y-%m-%d') || ')', chr(10) ORDER BY event_id) AS text, count(*) AS record_count, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 10), ',') AS record_types FROM events GROUP BY user_id",
    "xml_workouts": "SELECT user_id, string_agg('Workout: ' || event_type || ' - ' || event_id || 'min ()', chr(10) ORDER BY event_id) AS text, count(*) AS record_count, CAST(0 AS BIGINT) AS n_types FROM events GROUP BY user_id",
    "xml_generic": "SELECT user_id, string_agg(event_id || chr(10) || event_type, chr(10) ORDER BY event_id) AS text, CAST(0 AS BIGINT) AS record_count FROM events GROUP BY user_id",
    "xml_partial_error": "SELECT user_id, string_agg(event_type || ': ' || event_id, chr(10) ORDER BY event_id) AS text, true AS failed, true AS partial FROM events GROUP BY user_id",
    "office_source": "SELECT replace(p_brand, '#', '-') || '.xlsx' AS filename, count(*) AS total_rows, chr(10) || '[Sheet: ' || replace(p_brand, '#', '-') || ']' || chr(10) || string_agg(p_partkey || chr(9) || p_size, chr(10) ORDER BY p_partkey, p_size) AS text, CAST(NULL AS VARCHAR) AS error FROM part GROUP BY p_brand",
    "sketch_events": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "sample_orders": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln((CAST('0x' || substr(md5(o_orderkey || '|7'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / o_totalprice) <= 40",
    "sample_clicks": "SELECT click_id, kind FROM (SELECT DISTINCT click_id, kind FROM clicks) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(click_id || '|0') DESC) <= 100",
    "xlsx_rows": "SELECT o_custkey, chr(10) || '[Sheet: C' || o_custkey || ']' || coalesce(chr(10) || string_agg(o_orderkey || chr(9) || CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus ELSE '' END || chr(9) || CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END, chr(10) ORDER BY o_orderkey) FILTER (o_orderkey % 5 <> 4), '') AS text, count(*) FILTER (o_orderkey % 5 <> 4) AS total_rows, CAST(1 AS BIGINT) AS page_count FROM orders GROUP BY o_custkey",
    "docx_paragraphs": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents",
    "docx_fallback": "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents",
    "pdf_lines": r"SELECT o_custkey, '[Page 1]' || chr(10) || chr(10) || string_agg(o_orderstatus || ' (\' || o_orderkey || ')', chr(10) ORDER BY o_orderkey) AS text, CAST(1 AS BIGINT) AS page_count FROM orders GROUP BY o_custkey",
    "pdf_tables": "SELECT o_custkey, '[Page 1]' || chr(10) || chr(10) || string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey) || chr(10) || chr(10) || string_agg(o_orderkey || chr(9) || o_orderstatus, chr(10) ORDER BY o_orderkey) AS text, CAST(1 AS INTEGER) AS tables_found FROM orders GROUP BY o_custkey",
    "table_to_tsv": "SELECT o_custkey, coalesce(string_agg(CASE WHEN o_orderkey % 6 <> 5 THEN CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus ELSE '' END || chr(9) || o_orderkey || chr(9) END, chr(10) ORDER BY o_orderkey), '') AS text FROM orders GROUP BY o_custkey",
    "pieces_newline": _numbered("doc_id", _pieces("text", "chr(10)", True), "documents"),
    "pieces_sentence": _numbered("doc_id", _pieces("text", "'. '", False), "documents"),
    "pieces_word": "WITH s AS (SELECT doc_id, string_split(text, ' ') AS p FROM documents), u AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS w, len(p) AS n FROM s) SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN i < n - 1 THEN w || ' ' ELSE w END AS piece FROM u WHERE i < n - 1 OR w <> ''",
    "pieces_char": "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, substr(p_name, i, 1) AS piece FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)",
    "overlap_tail": "WITH s AS (SELECT doc_id, string_split(text, ' ') AS p FROM documents), u AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS w, len(p) AS n FROM s), v AS (SELECT doc_id, i, CASE WHEN i < n - 1 THEN w || ' ' ELSE w END AS piece FROM u WHERE i < n - 1 OR w <> ''), r AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS total FROM v) SELECT doc_id, count(*) FILTER (total <= 51) AS n, coalesce(string_agg(piece, '' ORDER BY i) FILTER (total <= 51), '') AS text FROM r GROUP BY doc_id",
    "split_words": _WORDS + "SELECT conv_id, turn, chunk_index, content FROM n",
    "split_lateral": _WORDS + "SELECT conv_id, turn, chunk_index, content FROM n",
    "split_forced": _FORCED,
    "split_documents_meta": _WORDS + "SELECT conv_id, turn, chunk_index, total AS total_chunks, CAST(length(content) AS INTEGER) AS chunk_size, conv_id AS source FROM n",
    "split_no_loss": "SELECT doc_id, true AS ok FROM documents",
    "strip_unicode": f"SELECT conv_id, turn, {_STRIP.format(x='p || text || p')} AS text FROM (SELECT *, [chr(160) || chr(9), chr(8195) || chr(10), chr(12288) || chr(28), ' ' || chr(133), ''][turn % 5 + 1] AS p FROM conversations)",
    "preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents",
    "score_badge": "SELECT o_orderkey, CASE WHEN o_orderkey % 1000 > 700 THEN 'green' ELSE 'yellow' END AS badge FROM orders",
    "chunk_ids": "SELECT doc_id, 'doc' || doc_id || '_' || CASE WHEN doc_id * 37 < 10000 THEN lpad(CAST(doc_id * 37 AS VARCHAR), 4, '0') ELSE CAST(doc_id * 37 AS VARCHAR) END AS id FROM documents",
    "decode_metadata": "SELECT doc_id, true AS there, CASE WHEN doc_id % 5 > 1 THEN source END AS source, CASE WHEN doc_id % 5 > 1 THEN doc_id END AS page_count FROM documents",
    "record_type_cap": "SELECT g, array_to_string(list_slice(list_sort(list(DISTINCT type)), 1, 10), ',') AS types FROM (SELECT user_id % 7 AS g, event_type || (event_id % 5) AS type FROM events) GROUP BY g",
    "upsert_last_wins": "SELECT id, seq, price, status FROM (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F' DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "delete_ids": "SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "store_stats": f"SELECT count(DISTINCT id) AS chunk_count, count(DISTINCT id) FILTER (seq % 5 <> 0) AS vector_count FROM {_STORED}",
    "orphan_chunks": f"SELECT id, max_by(text, seq) AS text FROM {_STORED} GROUP BY id HAVING count(*) FILTER (seq % 5 <> 0) = 0",
    "stored_chunks": f"SELECT id, max_by(text, seq) AS text, id AS filename FROM {_STORED} GROUP BY id",
    "clear_store": "SELECT CAST(0 AS BIGINT) AS chunk_count, CAST(0 AS BIGINT) AS vector_count",
    "ingest_failures": f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Extraction error: Extraction failed: no ' || doc_id WHEN doc_id % 7 = 0 OR coalesce({_STRIP.format(x='text')}, '') = '' THEN 'No text content extracted from document' END AS failure FROM documents",
    "ingest_turns": _TURNS + "SELECT '/in/c' || conv_id || '-' || turn || '.docx' AS file, CAST(count(content) AS INTEGER) AS total_chunks, CAST(count(content) AS INTEGER) AS vectors_stored, coalesce(string_agg('c' || conv_id || '-' || turn || '_' || lpad(CAST(chunk_index AS VARCHAR), 4, '0'), ',' ORDER BY chunk_index), '') AS chunk_ids, CASE WHEN count(content) = 0 THEN 'No text content extracted from document' ELSE '' END AS errors FROM conversations LEFT JOIN n USING (conv_id, turn) GROUP BY conv_id, turn",
    "ingest_processed": _TURNS + "SELECT count(*) AS processed FROM (SELECT DISTINCT conv_id, turn FROM n)",
    "embed_search_e2e": f"""WITH v AS (SELECT id, max_by(text, seq) FILTER (seq % 5 <> 0) AS vtext, max(seq) FILTER (seq % 5 <> 0) AS vseq, max_by(text, seq) AS text FROM {_STORED} GROUP BY id),
w AS (SELECT id, md5(w) AS h FROM (SELECT id, unnest(string_split(lower(vtext), ' ')) AS w FROM v UNION ALL SELECT NULL, unnest(string_split(lower(p_name), ' ')) FROM part WHERE p_partkey = 1) WHERE w <> ''),
b AS (SELECT id, CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) % 384 AS INTEGER) AS i, CAST(sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM w GROUP BY ALL),
n AS (SELECT id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12) AS x FROM b),
s AS (SELECT id, i, {_HALF.format(x="x")} AS x FROM n WHERE id IS NOT NULL),
t AS (SELECT s.id, coalesce(sum(s.x * q.x), 0) / sqrt(sum(s.x * s.x)) AS score FROM s LEFT JOIN (SELECT i, x FROM n WHERE id IS NULL) q ON q.i = s.i GROUP BY s.id)
SELECT id, text, round(score, 6) + 0.0 AS score FROM t JOIN v USING (id) WHERE vseq IS NOT NULL ORDER BY score DESC, vseq LIMIT 5""",
}
