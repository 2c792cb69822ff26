"""DuckDB SQL for the MinHash query: exact set similarities, no signatures."""

MINHASH_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM split
), classes AS MATERIALIZED (
  SELECT s, len(s) AS n, min(doc_id) AS cls FROM sets WHERE len(s) > 0 GROUP BY s
), posted AS MATERIALIZED (
  SELECT cls, n, unnest(s) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT a.cls AS a, b.cls AS b FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.cls <> b.cls
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT cls AS a, cls AS b FROM classes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), named AS (
  SELECT c.s, min(r.b) AS component_id FROM classes c JOIN reach r ON r.a = c.cls GROUP BY c.s, c.cls
)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(n.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(n.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN named n ON n.s = d.s"""
