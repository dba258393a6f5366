"""DuckDB SQL of those queries that SQL can express over whole tables."""

from __future__ import annotations

from tesserae.llm import licenses

SHARDING = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
hexed AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, strlen(body) AS n, list_transform(range(0, (length(h) // 2)::BIGINT), lambda i:
            ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) AS b FROM hexed),
sized AS (SELECT doc_id, (n + 16)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, crc_table),
bid AS (SELECT doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS bid
        FROM (SELECT DISTINCT doc_id FROM documents), range(41) r(s)),
won AS (SELECT doc_id, (arg_min(s, bid) FILTER (s < 40))::INT AS shard, arg_min(s, bid)::INT AS grown_shard FROM bid GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot|' || coalesce(d.doc_id::VARCHAR, '')), 1, 2), d.doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
       grown_shard
FROM sized d JOIN won w ON d.doc_id IS NOT DISTINCT FROM w.doc_id
"""

MIXING = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
         substr(md5('row|' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS block,
         md5('in|7|' || coalesce(doc_id::VARCHAR, '')) AS inb FROM documents),
t AS (SELECT key, sum(n)::BIGINT AS tokens FROM r GROUP BY key),
s AS (SELECT list(tokens / al ORDER BY tokens) AS sh, any_value(al) AS al FROM (SELECT tokens, (sum(tokens) OVER ())::DOUBLE AS al FROM t WHERE tokens > 0)),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT b.*, list_max(list_transform(sh, lambda p: pow(p, (lo + hi) / 2 - 1.0))) / list_min(list_transform(sh, lambda p: pow(p, (lo + hi) / 2 - 1.0))) <= 2.0 AS ok
        FROM b, s WHERE i < 50)),
e AS (SELECT round(CASE WHEN list_max(list_transform(sh, lambda p: pow(p, -1.0))) / list_min(list_transform(sh, lambda p: pow(p, -1.0))) <= 2.0
               THEN 0.0 ELSE hi END, 9) AS a, sh, al FROM b, s WHERE i = 50),
g AS (SELECT a, al, list_sum(list_transform(sh, lambda p: pow(p, a))) AS norm, list_max(list_transform(sh, lambda p: pow(p, 1.0 - a))) AS top FROM e),
w AS (SELECT key, tokens, pow(tokens / al, a) / norm AS w, round(al * top * norm * (pow(tokens / al, a) / norm))::BIGINT AS budget FROM t, g WHERE tokens > 0
      UNION ALL SELECT key, tokens, 0.0, NULL FROM t WHERE tokens = 0),
p AS (SELECT key, round(w, 9) AS weight, coalesce(budget // tokens, 1)::INT AS epochs, coalesce(budget % tokens, 0) AS rest FROM w),
o AS (SELECT r.*, weight, epochs, rest,
             sum(n) OVER (PARTITION BY r.key ORDER BY md5('7|' || r.key || '|' || epochs || '|' || block), block, inb, doc_id, n ROWS UNBOUNDED PRECEDING) AS used
      FROM r JOIN p ON r.key = p.key),
d AS (SELECT *, unnest(range(0, epochs + CASE WHEN rest > 0 AND used <= rest THEN 1 ELSE 0 END)) AS epoch FROM o)
SELECT doc_id, source, n AS n_tokens, weight, epoch::INT AS epoch,
       substr(md5('7|' || key || '|' || epoch || '|' || block), 1, 16) || substr(inb, 1, 16) AS mix_order FROM d
"""

SEARCH = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
               FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY r, term),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term),
p AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS impact FROM tf JOIN w USING (term), s),
t AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY item_id, text, r),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 50
"""

SQL: dict[str, str] = {"op2_sharding": SHARDING, "op6_licenses": licenses.duckdb_sql(), "op10_mixing": MIXING, "op12_search": SEARCH}
