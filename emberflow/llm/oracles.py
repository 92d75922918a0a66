"""SQL of the corpus queries that SQL can express, each by the definition and not by the operator's way."""

MIDDLE = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), b AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain,
    ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm
  FROM a
), c AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM b
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS of_lang
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS p,
    1 + (1000000000 * (of_lang + 5)::HUGEINT) // (sum(of_lang) OVER s + 5 * count(*) OVER s)::HUGEINT AS q
  FROM cell WINDOW s AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

REPEATS = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS MATERIALIZED (
  SELECT r, c, substr(h, 800 * c + 1, 1598) AS s FROM (SELECT r, h, unnest(range(0, len(h) // 800)) AS c FROM d WHERE len(h) >= 800)
), p AS (
  SELECT r, 400 * c + j AS i, md5(substr(s, 2 * j + 1, 800)) AS k FROM (SELECT r, c, s, unnest(range(0, len(s) // 2 - 399)) AS j FROM piece)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS m FROM p) WHERE m > 1
), run AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit)
), span AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY r, g
), kept AS (
  SELECT r, string_agg(part, '' ORDER BY a) AS h FROM (
    SELECT s.r, s.a, substr(d.h, 2 * coalesce(lag(s.b) OVER w, 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER w, 0))) AS part FROM span s JOIN d USING (r) WINDOW w AS (PARTITION BY s.r ORDER BY s.a)
    UNION ALL
    SELECT s.r, max(s.b), substr(any_value(d.h), 2 * max(s.b) + 1) FROM span s JOIN d USING (r) GROUP BY s.r
  ) GROUP BY r
), sums AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r
)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
