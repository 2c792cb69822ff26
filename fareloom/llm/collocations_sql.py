"""DuckDB SQL for the collocation query: every phrase of every piece is listed and counted."""

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), parts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM parts)
), cuts AS (
  SELECT h.lang, h.phrase, h.a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * h.a) // (x.f + y.f) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), sized AS (
  SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM parts)
), inner_phrases AS MATERIALIZED (
  SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a AS longer FROM sized
), gone AS (
  SELECT DISTINCT i.lang, i.phrase FROM inner_phrases i JOIN f ON f.lang = i.lang AND f.phrase = i.phrase WHERE 100 * i.longer >= 80 * f.f
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b ANTI JOIN gone g ON g.lang = b.lang AND g.phrase = b.phrase
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000"""
