"""DuckDB twins of the queries of operators 12 and 13."""

from __future__ import annotations

#: Unsigned CRC-32 of a text of ASCII characters; {0} is the text.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"

_ENCODED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_ENCODED.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

#: op13: levels of the trees of each lang, then of their subroots; siblings of each leaf in the order of levels; the fold over them.
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf,
    CASE WHEN {CRC.format("(doc_id::VARCHAR)")} % 7 = 0 THEN {_LEAF.format("(n_chars::HUGEINT + 1)")} END AS forged
  FROM documents
), spots AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low AS (
  SELECT tree, 0 AS level, place AS node, leaf AS digest, count(*) OVER (PARTITION BY tree) AS nodes FROM spots
  UNION ALL
  SELECT tree, level + 1, node // 2, sha256(string_agg(digest, '' ORDER BY node)), (any_value(nodes) + 1) // 2
  FROM low WHERE nodes > 1 GROUP BY tree, level, node // 2
), subroots AS (
  SELECT tree, digest FROM low WHERE nodes = 1
), top AS (
  SELECT 0 AS level, tree AS node, digest, count(*) OVER () AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, node // 2, sha256(string_agg(digest, '' ORDER BY node)), (any_value(nodes) + 1) // 2
  FROM top WHERE nodes > 1 GROUP BY level, node // 2
), steps AS (
  SELECT s.tree, s.place, own.level, CASE WHEN l.node % 2 = 0 THEN 'L' ELSE 'R' END AS side, coalesce(l.digest, '') AS digest
  FROM spots s JOIN low own ON own.tree = s.tree AND own.nodes > 1 AND own.node = s.place >> own.level
  LEFT JOIN low l ON l.tree = own.tree AND l.level = own.level AND l.node = xor(own.node, 1)
  UNION ALL
  SELECT s.tree, s.place, 1000 + own.level, CASE WHEN t.node % 2 = 0 THEN 'L' ELSE 'R' END, coalesce(t.digest, '')
  FROM spots s JOIN top own ON own.nodes > 1 AND own.node = s.tree >> own.level
  LEFT JOIN top t ON t.level = own.level AND t.node = xor(own.node, 1)
), paths AS (
  SELECT tree, place, list(side || digest ORDER BY level) AS path, string_agg(digest, '' ORDER BY level) AS proof
  FROM steps GROUP BY tree, place
), folded AS (
  SELECT s.*, r.digest AS subroot, (SELECT digest FROM top WHERE nodes = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(forged, leaf), coalesce(path, [])),
      lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM spots s JOIN subroots r USING (tree) LEFT JOIN paths USING (tree, place)
)
SELECT doc_id, place::BIGINT AS place, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

#: op12: prefixes as digests of lists of turns; totals by every node's own prefixes.
OP12 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({{'v': md5(len(role) || ':' || role || text), 'n': strlen(text)}} ORDER BY turn NULLS FIRST, role, md5(len(role) || ':' || role || text)) AS w,
    {CRC.format("(conv_id::VARCHAR)")} % 9 AS h
  FROM t GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), paths AS (
  SELECT conv_id, d, len(w) = d AS ends, sha256(coalesce(array_to_string(list_transform(w[1:d], lambda x: x.v), ''), '')) AS p, CASE WHEN d > 0 THEN w[d].n ELSE 0 END AS n
  FROM rebuilt, unnest(range(0, len(w) + 1)) AS r(d)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, p
), named AS (
  SELECT x.*, up.conv_id AS parent_conv_id FROM nodes x
  LEFT JOIN paths q ON q.conv_id = x.conv_id AND q.d = x.d - 1 LEFT JOIN nodes up ON up.d = q.d AND up.p = q.p
), kids AS (
  SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM named WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT named.*, coalesce(n_children, 0) AS n_children FROM named LEFT JOIN kids USING (conv_id, d)
), totals AS (
  SELECT q.d, q.p, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved_tokens
  FROM full_nodes u JOIN paths q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY q.d, q.p
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN totals USING (d, p)
"""
