"""DuckDB SQL of the joins on pairs: all pairs are compared, which small tables allow."""

_REACH = """
reach(id, low) AS (SELECT {id}, {id} FROM nodes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"""

EMBEDDINGS = """
WITH RECURSIVE nodes AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM nodes),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),""" + _REACH.format(id="vec_id") + """,
counts AS (SELECT a, count(*) AS c FROM links GROUP BY a)
SELECT vec_id, coalesce(c, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON id = vec_id LEFT JOIN counts ON a = vec_id
"""

NGRAMS = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts WHERE len(w) > 0)),
nodes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN nodes x ON x.doc_id = a JOIN nodes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),""" + _REACH.format(id="doc_id") + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id
FROM documents d LEFT JOIN nodes USING (doc_id) LEFT JOIN least ON id = d.doc_id
"""

BYTES = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, t, n, unnest(range(1, n + 1)) AS p FROM docs),
strings AS (SELECT doc_id, n, p, array_slice(t, p, p) AS byte, CASE WHEN p + 99 <= n THEN array_slice(t, p, p + 99) END AS s FROM places),
firsts AS (SELECT s, min({'d': doc_id, 'p': p}) AS f FROM strings WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
later AS (SELECT strings.*, f IS NOT NULL AND {'d': doc_id, 'p': p} > f AS r FROM strings LEFT JOIN firsts USING (s)),
covered AS (SELECT *, coalesce(max(CASE WHEN r THEN p END) OVER (PARTITION BY doc_id ORDER BY p) >= p - 99, false) AS c FROM later),
runs AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM covered),
kept AS (SELECT doc_id, count(*) FILTER (c) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(hex(byte), '' ORDER BY p) FILTER (NOT c), '') AS k FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
