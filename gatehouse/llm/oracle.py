"""DuckDB SQL for those operators that SQL can express on whole tables."""

from __future__ import annotations

_URL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://([^?#]*)', 1) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/]*(/?.*)$', 1, 's') AS path
  FROM cut
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
         max_by(action, length(rhost) * 1000 + length(rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents
), ranked AS (
  SELECT *, u / (1 - u) AS rank FROM (
    SELECT *, (('0x' || substr(digest, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM sized)
), src AS (
  SELECT source, sum(size)::BIGINT AS words,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), water AS (
  SELECT *, 3 * words AS cap, sum(words) OVER () AS total,
         coalesce(sum(3 * words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM src WINDOW o AS (ORDER BY 3 * words / w::DOUBLE, source NULLS LAST)
), free AS (
  SELECT (total - cap_before)::DOUBLE AS room, w_left::DOUBLE AS room_w, cap / w::DOUBLE AS level
  FROM water WHERE cap > (total - cap_before)::DOUBLE * w / w_left
  ORDER BY level, source NULLS LAST LIMIT 1
), target AS (
  SELECT source, words, least(cap::DOUBLE, CASE
           WHEN room IS NULL OR cap <= (total - cap_before)::DOUBLE * w / w_left THEN cap::DOUBLE
           ELSE room * w / room_w END) AS target
  FROM water LEFT JOIN free ON true
), split AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole FROM target
), run AS (
  SELECT r.*, s.words, s.target, s.whole, s.target - s.whole * s.words AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank, r.digest) AS upto
  FROM ranked r JOIN split s ON r.source IS NOT DISTINCT FROM s.source
), used AS (
  SELECT source, coalesce(max(upto) FILTER (upto <= rest), 0) AS used, max(rest) AS rest FROM run GROUP BY source
), filler AS (
  SELECT r.source, min_by(r.digest, (abs(r.size - (u.rest - u.used)), r.rank, r.digest)) AS digest
  FROM run r JOIN used u ON r.source IS NOT DISTINCT FROM u.source
  WHERE r.size > 0 AND r.upto > r.rest AND u.rest > 0 AND abs(r.size - (u.rest - u.used)) < u.rest - u.used
  GROUP BY r.source
)
SELECT r.doc_id, r.size, r.words AS source_size, r.target,
       (r.size * (r.whole + CASE WHEN r.upto <= r.rest OR f.digest = r.digest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run r LEFT JOIN filler f ON r.source IS NOT DISTINCT FROM f.source
"""

_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS name
  FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY name ORDER BY doc_id, k) AS nth FROM w WHERE name IS NOT NULL
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, k + o AS k FROM later, (VALUES (0), (1), (2)) t(o)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE g.k IS NULL) AS text,
         count(f.k)::BIGINT AS n_lines, count(g.k)::BIGINT AS n_deleted
  FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.no = f.no LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.k = g.k
  GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLES = {"op6_line_dedup": _LINES, "op9_url_filter": _URL, "op4_mixing": _MIX}
