"""DuckDB's SQL for the registered queries that SQL can express, beside that of mixing and urls."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[s:s + 4], ' ')) AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, v.b FROM reach r JOIN ways v ON r.b = v.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
start AS (SELECT doc_id, s AS pos, md5(array_to_string(ws[s:s + 34], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY win) AS k FROM start) WHERE k > 1),
gone AS (SELECT one.*, max(CASE WHEN t.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY one.doc_id ORDER BY one.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS cut
  FROM one LEFT JOIN twice t ON one.doc_id = t.doc_id AND one.pos = t.pos),
per AS (SELECT doc_id, count(*) AS n_words, CAST(sum(cut) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (cut = 0) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)"""
