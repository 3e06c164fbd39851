"""SQL for the queries that SQL can express, over whole tables."""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
classes AS (SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM sets WHERE len(sh) > 0 GROUP BY 1),
tok AS (SELECT rep, len(sh) AS n, unnest(sh) AS t FROM classes),
common AS (SELECT t FROM tok GROUP BY t HAVING count(*) > 1),
shared AS (SELECT tok.* FROM tok JOIN common USING (t)),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM shared a JOIN shared b ON a.t = b.t AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON list_sort(s.sh) = c.sh LEFT JOIN comp ON comp.rep = c.rep
"""

DECONTAMINATE = r"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM item_words WHERE len(ws) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
doc_wins AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM doc_wins d JOIN wins w ON d.n = w.n AND d.win = w.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(len(i.items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(i.items, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

SQL = {"op7_jaccard": JACCARD, "op9_decontaminate": DECONTAMINATE}
