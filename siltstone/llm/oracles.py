"""DuckDB equivalents of the operators that SQL can express, written from the contracts and not from the plans."""

from __future__ import annotations

from . import decontam, ledger

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: All pairs of distinct sets that share a shingle, and components by reachability.
NEAR = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), LOWER), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS MATERIALIZED (SELECT md5(array_to_string(list_sort(g), chr(10))) AS k, min(doc_id) AS id, any_value(g) AS g FROM s WHERE len(g) > 0 GROUP BY ALL),
e AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
o AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * k >= 85 * (n - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept, coalesce(c.id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON len(s.g) > 0 AND md5(array_to_string(list_sort(s.g), chr(10))) = c.k LEFT JOIN m ON m.id = c.id
""".replace("LOWER", _LOWER)

#: One group after another, largest first, to the least-loaded of 16 shards; crc32 byte by byte.
SHARDS = r"""
WITH RECURSIVE z AS (SELECT CAST(range AS UBIGINT) AS i, CAST(range AS UBIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM z WHERE k < 8),
y AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM z WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, coalesce(md5(text), 'none') AS key, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
g AS MATERIALIZED (SELECT key, sum(size) AS total, row_number() OVER (ORDER BY sum(size) DESC, key) AS i FROM d GROUP BY key),
f AS (SELECT 0::BIGINT AS i, list_transform(range(16), lambda s: 0::HUGEINT) AS loads, 0 AS shard
  UNION ALL SELECT g.i, list_transform(range(16), lambda s: loads[s + 1] + CASE WHEN s + 1 = list_position(loads, list_min(loads)) THEN g.total ELSE 0 END), list_position(loads, list_min(loads)) - 1 FROM f JOIN g ON g.i = f.i + 1),
h AS MATERIALIZED (SELECT DISTINCT x, hex(encode(x)) AS h FROM d),
r AS (SELECT x, xor(list_reduce(list_transform(range(1, strlen(h), 2), lambda j: CAST(('0x' || substr(h, j, 2)) AS UBIGINT)), lambda c, b: xor(c // 256, tab[CAST(xor(c % 256, b) AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc FROM h, y)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN g USING (key) JOIN f ON f.i = g.i JOIN r USING (x)
"""

#: Every 400-byte string of every text, by md5.
SUFFIXES = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, strlen(h) // 2 - 399)) AS i FROM d)),
t AS MATERIALIZED (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
q AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p JOIN t USING (k)),
g AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM q),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, run),
n AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list([a, b] ORDER BY a) AS l FROM s GROUP BY r),
w AS (SELECT doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([[0, 0]], coalesce(l, []), [[strlen(h) // 2, strlen(h) // 2]]) AS l FROM d LEFT JOIN n USING (r))
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
sha256(unhex(array_to_string(list_transform(range(1, len(l)), lambda k: substr(h, 2 * l[k][2] + 1, 2 * (l[k + 1][1] - l[k][2]))), ''))) AS kept_sha256 FROM w
"""

#: Every score by its formula.
RANKED = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), LOWER), 'TERM') AS w FROM documents),
g AS MATERIALIZED (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), LOWER), 'TERM')) AS t FROM benchmark),
f AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM f GROUP BY t), g),
s AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n) // CAST(l AS BIGINT))))) AS score FROM q JOIN v USING (t) JOIN f USING (t) JOIN d USING (r), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""".replace("LOWER", _LOWER).replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Every window as a sorted list.
ROLLING = """
WITH c AS MATERIALIZED (SELECT click_id, r.kind AS kind, r.ts AS ts, CAST(floor(100 * r.value + 0.5) AS BIGINT) AS c FROM (SELECT click_id, min({'gone': ts IS NULL, 'ts': ts, 'kind': kind, 'value': value}) AS r FROM clicks GROUP BY click_id) WHERE NOT r.gone),
w AS (SELECT click_id, kind, c, list_sort(list(c) FILTER (c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)) AS l FROM c),
m AS (SELECT click_id, kind, c, l, coalesce(len(l), 0) AS n, CASE WHEN len(l) >= 2 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM w),
a AS (SELECT click_id, kind, c, n, median2, CASE WHEN n >= 2 THEN list_sort(list_transform(l, lambda x: abs(2 * x - median2))) END AS l FROM m),
b AS (SELECT click_id, kind, c, n, median2, CASE WHEN n >= 2 THEN l[(n + 1) // 2] + l[n // 2 + 1] END AS mad4 FROM a)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, CAST(median2 AS BIGINT) AS median2, CAST(mad4 AS BIGINT) AS mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM b
"""



def _secrets() -> str:
    """Each rule's matches in each text, between marks, so that lengths give their places."""
    mark = "chr(57344)"
    parts = [
        f"SELECT r, {i} AS o, '{x.kind}' AS kind, string_split(regexp_replace(x, '({p})', {mark} || '\\1' || {mark}, 'g'), {mark}) AS l, list_transform(l, lambda y: length(regexp_extract(y, '{p}', {x.group})) >= {x.least}) AS ok FROM d"
        for i, x in enumerate(ledger.RULES)
        for p in [x.pattern.replace("'", "''")]
    ]
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x FROM documents),
p AS ({" UNION ALL ".join(parts)}),
e AS (SELECT r, o, kind, ok, l, unnest(range(2, len(l) + 1, 2)) AS k FROM p WHERE len(l) > 1),
s AS (SELECT r, o, kind, CAST(list_sum(list_transform(l[1:k - 1], lambda y: length(y))) AS BIGINT) AS a, length(l[k]) AS n FROM e WHERE ok[k]),
j AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""


SQL = {
    "op1_circulant_minhash": NEAR,
    "op4_prefix_decontamination": decontam.ORACLE,
    "op7_lpt_shards": SHARDS,
    "op10_suffix_merge": SUFFIXES,
    "op11_wand_search": RANKED,
    "op12_rolling_median": ROLLING,
    "op13_blob_ledger": _secrets(),
}
