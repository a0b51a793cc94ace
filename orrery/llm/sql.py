"""DuckDB SQL for the queries that SQL can express."""

from .quality_rules import BOILERPLATE, ENDS, SEPARATORS

#: The phrases and limits are those of quality_rules.
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
w AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS own,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1) AS final
  FROM l),
s AS (SELECT *, n BETWEEN 1 AND 4 AND NOT contains('{ENDS}', final) AS listed FROM w),
u AS (SELECT *, sum((NOT listed)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s),
v AS (SELECT *, listed AND count(*) FILTER (WHERE listed) OVER (PARTITION BY doc_id, island) >= 4 AS in_list FROM u),
j AS (
  SELECT *, n > 0 AND row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
    n > 0 AND (regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')
      OR length(regexp_replace(line, '[^{SEPARATORS}]', '', 'g')) > 0.2 * n
      OR (n > 2 AND length(regexp_replace(line, '[^!]', '', 'g')) > 0.25 * n)
      OR symbols > 0.05 * length(line) OR in_list OR count(*) OVER (PARTITION BY doc_id, line) >= 4) AS bad
  FROM v),
a AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, sum(own)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, (count(*) FILTER (WHERE dup))::BIGINT AS n_dup_lines,
    (count(*) FILTER (WHERE bad))::BIGINT AS n_removed_lines, coalesce(sum(own) FILTER (WHERE bad), 0)::BIGINT AS lost_chars
  FROM j GROUP BY doc_id),
x AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM x WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM g, range(0, 3) AS t(o) WHERE c > 1 GROUP BY doc_id),
b AS (
  SELECT a.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM a LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, lost_chars, base_failed,
  NOT base_failed AND 2 * (word_chars - lost_chars) >= word_chars AS kept
FROM b
"""

SUBSTRING_DEDUP = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM x WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS q FROM p),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY q ORDER BY doc_id, i) AS rn FROM k),
c AS (SELECT DISTINCT doc_id, i + o AS j FROM g, range(0, 20) AS t(o) WHERE rn > 1),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM x),
m AS (SELECT w.doc_id, w.w, w.j, c.j IS NOT NULL AS gone FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.j = w.j),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY j) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM x LEFT JOIN a ON a.doc_id = x.doc_id
"""

SUFFIX_DEDUP = r"""
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(hx) // 2 - 399)) AS i, hx FROM x WHERE len(hx) >= 800),
k AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 800)) AS q FROM p),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY q) AS n FROM k),
f AS (SELECT doc_id, i FROM g WHERE n > 1),
e AS (SELECT doc_id, i, sum(CASE WHEN i <= prev + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS prev FROM f)),
s AS (SELECT doc_id, island, min(i) AS a, max(i) + 400 AS z FROM e GROUP BY doc_id, island),
r AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt FROM s),
t AS (
  SELECT r.doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
    string_agg(substr(hx, 2 * before + 1, 2 * (a - before)) || CASE WHEN nxt IS NULL THEN substr(hx, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS left_hex
  FROM r JOIN x ON x.doc_id = r.doc_id GROUP BY r.doc_id)
SELECT x.doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_hex, hx))) AS kept_sha256
FROM x LEFT JOIN t ON t.doc_id = x.doc_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 2))) AS i, ws FROM x WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT node, least(node, min(other)) AS component_id FROM r GROUP BY node)
SELECT x.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, x.doc_id) AS component_id, coalesce(m.component_id, x.doc_id) = x.doc_id AS kept
FROM x LEFT JOIN n ON n.doc_id = x.doc_id LEFT JOIN m ON m.node = x.doc_id
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM x WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda a: a IS NULL OR isnan(a) OR isinf(a)), true) AND list_contains(list_transform(e, lambda a: a <> 0), true)),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
r(node, other) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT node, least(node, min(other)) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.component_id, x.vec_id) AS component_id, coalesce(m.component_id, x.vec_id) = x.vec_id AS kept
FROM x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN m ON m.node = x.vec_id
"""

#: Every row once and unchanged, in fewer shards than arrived.
SHARDING = """SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5, true AS compacted FROM documents"""
