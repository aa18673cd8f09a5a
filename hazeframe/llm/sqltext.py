"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

# The mix: sizes and hashes, the water level over the sources sorted by the level that clamps them, and the
# fractional repetition in hash order.
MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '11', coalesce(doc_id::VARCHAR, 'null'), coalesce(text, ''))), 1, 13))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS j,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s),
lv AS (
  SELECT (1.5::DOUBLE * t.total - capped) / open AS level
  FROM o, (SELECT sum(source_size)::DOUBLE AS total FROM s) t
  WHERE (1.5::DOUBLE * t.total - capped) / open < cap / w OR t.total = 0
  ORDER BY j LIMIT 1),
p AS (
  SELECT source, source_size, least(cap, level * w) AS target FROM s, lv),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM p),
r AS (
  SELECT *, round(target)::BIGINT - whole * source_size AS rest FROM q),
g AS (
  SELECT source, place, sum(size) AS words, count(*) FILTER (WHERE size > 0) AS same,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto
  FROM d GROUP BY source, place),
c AS (
  SELECT g.source, g.place AS cut, ((r.rest - g.upto + g.words) // g.same)::BIGINT AS part
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source
  WHERE r.rest > 0 AND g.upto >= r.rest AND g.upto - g.words < r.rest)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * r.whole + CASE WHEN d.place < c.cut THEN d.size WHEN d.place = c.cut THEN least(d.size, c.part) ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

# The trie: prefixes as lists of turn digests, subtree sums over the prefixes of each node's representative.
TRIE = """
WITH t AS (
  SELECT conv_id, length(coalesce(text, ''))::BIGINT AS len, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                 lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
             4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, t.pos, len, md5(length(role) || ':' || role || text) AS turn
  FROM c JOIN t ON t.conv_id = c.head WHERE t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, len, md5(length(role) || ':' || role || text) FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, list(turn) OVER w AS path, len FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM m GROUP BY path, depth),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, u.conv_id AS parent_conv_id
  FROM n LEFT JOIN k ON n.path = k.path AND n.depth = k.depth
  LEFT JOIN n u ON n.depth = u.depth + 1 AND u.path = list_slice(n.path, 1, n.depth - 1)),
s AS (
  SELECT p.path, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.len) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.path = s.path
"""
