"""DuckDB SQL of the queries of this subpackage that SQL can express, over the same tables."""

from __future__ import annotations

OP6 = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES {rules})
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM urls
"""

# crc32 by its table of 256 entries, over the UTF-8 bytes of letters up to U+00FF
OP11 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, run, count(*) AS c FROM runs GROUP BY ALL),
coded AS (
  SELECT run, c, flatten(list_transform(string_split(head || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS bytes FROM counted),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS part, 1 AS cut FROM words, range(0, length(word)) r(i)),
shapes AS (SELECT word, n, i, part, cut FROM cuts UNION ALL SELECT word, n, -1, word, 0 FROM words),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM shapes a JOIN shapes b ON a.part = b.part AND a.word <> b.word
  WHERE a.cut + b.cut = 1 OR a.cut + b.cut = 2 AND a.i = b.i),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
led AS (SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best),
chain AS (
  WITH RECURSIVE steps(word, here, depth) AS (
    SELECT word, word, 0 FROM words UNION ALL SELECT s.word, l.form, s.depth + 1 FROM steps s JOIN led l ON s.here = l.word WHERE l.form IS NOT NULL)
  SELECT word, arg_max(here, depth) AS root FROM steps GROUP BY word)
SELECT w.word, l.form, c.root, w.n, coalesce(l.n_near, 0)::BIGINT AS n_near, l.form_n FROM words w JOIN chain c USING (word) LEFT JOIN led l USING (word)
"""

_ROUND = """
far{r} AS (
  SELECT x.row_id, arg_min(c.k, (list_sum(list_transform(x.v, lambda e, i: (e - c.v[i]) * (e - c.v[i]))), c.k)) AS k,
         min(list_sum(list_transform(x.v, lambda e, i: (e - c.v[i]) * (e - c.v[i])))) AS d FROM x, c{r} c GROUP BY x.row_id)"""

_MOVE = """
part{r} AS (SELECT f.k, i, sum(x.v[i]) AS s, count(*) AS n FROM far{r} f JOIN x USING (row_id), range(1, 65) r(i) GROUP BY f.k, i),
mean{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM part{r} GROUP BY k),
c{n} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN mean{r} m USING (k))"""

OP13 = (
    """
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT 16)),"""
    + ",".join(_ROUND.format(r=r) + "," + _MOVE.format(r=r, n=r + 1) for r in range(3))
    + ","
    + _ROUND.format(r=3)
    + """
SELECT vec_id, f.k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM far3 f JOIN x USING (row_id) JOIN c3 c ON c.k = f.k
"""
)
