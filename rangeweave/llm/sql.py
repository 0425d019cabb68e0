"""DuckDB SQL with the same results as the queries of the same names."""

ORACLES: dict[str, str] = {}

ORACLES["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), x AS (
  SELECT (SELECT level FROM l WHERE level <= cap / w ORDER BY cap / w, r LIMIT 1) AS level
), t AS (
  SELECT source, source_size, coalesce(least(cap, x.level * w), cap) AS target FROM l, x
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), u AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY source, h
), c AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS b FROM u
), e AS (
  SELECT c.source, c.h, c.b, c.n, g.target - g.whole * g.source_size AS budget FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT source, h,
         (budget > 0 AND (b + n <= budget OR (b <= budget AND (budget - b) * 2 >= n)))::BIGINT AS extra FROM e
)
SELECT d.doc_id, d.size, g.source_size, g.target, ((g.whole + k.extra) * d.size)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

ORACLES["op4_decontamination"] = r"""
WITH b AS (
  SELECT item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS width, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS u(i)
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), dw AS (
  SELECT r, k.width, i, array_to_string(w[i:i + k.width - 1], ' ') AS win
  FROM d, (SELECT DISTINCT width FROM bw) k, unnest(range(1, len(w) - k.width + 2)) AS u(i)
), h AS (
  SELECT dw.r, dw.i, dw.width, bw.item_id FROM dw JOIN bw ON dw.width = bw.width AND dw.win = bw.win
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(h.i, h.i + h.width)) AS u(p) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(m.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r
"""
