"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict
    FROM parts JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM fits f WHERE f.page_id = parts.page_id) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule)) FROM fits f WHERE f.page_id = parts.page_id), 'allow') AS verdict
FROM parts
"""

OP7 = r"""
WITH weights(source, weight) AS (
    SELECT 'src' || i, CASE WHEN i = 0 THEN 3.0 ELSE 1.0 END FROM range(20) t(i)),
grouped AS (
    SELECT d.*, w.source AS g, coalesce(w.weight, 1.0) AS weight
    FROM documents d LEFT JOIN weights w ON d.source = w.source),
sizes AS (SELECT g, any_value(weight) AS weight, sum(coalesce(length(text), 0)) AS size FROM grouped GROUP BY g),
rates AS (
    SELECT g, weight / (SELECT sum(weight) FROM sizes WHERE size > 0)
              * (SELECT sum(size) FROM sizes) / size AS rate
    FROM sizes WHERE size > 0),
steps AS (
    SELECT g, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS at_most
    FROM rates, range(200) t(k)),
drawn AS (
    SELECT d.*, CAST('0x' || substr(md5('20:' || doc_id || ':' || md5(coalesce(text, '')) || ':0'), 1, 13) AS BIGINT)
                / 4503599627370496.0 AS u
    FROM grouped d),
counted AS (
    SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
           any_value(d.n_chars) AS n_chars, count(*) AS copies
    FROM drawn d JOIN steps s ON d.g IS NOT DISTINCT FROM s.g AND s.at_most <= d.u
    GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy,
       md5('20 place:' || doc_id || ':' || md5(coalesce(text, '')) || ':' || c) AS shuffle_key
FROM counted, range(copies) t(c)
"""

# Every 50-byte window of every text, as hexadecimal digits; touching windows are one run.
OP4 = r"""
WITH text_bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (      -- so that a window is cut from a short string
  SELECT doc_id, base, substr(h, 2 * base + 1, 1098) AS block
  FROM (SELECT *, unnest(range(0, greatest(len(h) // 2 - 49, 0), 500)) AS base FROM text_bytes)),
starts AS (SELECT *, unnest(range(0, len(block) // 2 - 49)) AS q FROM blocks),
windows AS (SELECT doc_id, base + q AS p, substr(block, 2 * q + 1, 100) AS s FROM starts),
first_in AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
gone AS (
  SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, -1) AS opens
  FROM windows JOIN first_in USING (s) WHERE doc_id > first_doc),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone) GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM runs),
folded AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, list((was, a) ORDER BY a) AS pieces FROM kept GROUP BY doc_id),
parts AS (
  SELECT f.doc_id, string_agg(substr(h, 2 * piece[1] + 1, 2 * (piece[2] - piece[1])), '' ORDER BY piece[1]) AS head
  FROM (SELECT doc_id, unnest(pieces) AS piece FROM folded) f JOIN text_bytes USING (doc_id) GROUP BY f.doc_id)
SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM text_bytes t LEFT JOIN folded USING (doc_id) LEFT JOIN parts USING (doc_id)
"""

ORACLE = {"op4_suffix_dedup": OP4, "op7_poisson_mixing": OP7, "op10_url_filter": OP10}
