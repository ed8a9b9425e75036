"""DuckDB twins of the contract's queries that SQL can express."""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.y, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.x = s.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.y, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.y, v.vec_id)) AS kept
FROM v LEFT JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM t
"""

SHARDING = """
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
n AS (SELECT d.d, h >> CAST(60 - d.d AS INTEGER) AS p, sum(n_bytes) AS b, count(*) AS c, sum(n_bytes) <= 1048576 OR min(h) = max(h) AS fits FROM r, (SELECT unnest(range(0, 61)) AS d) d GROUP BY ALL),
leaf AS (SELECT n.* FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.p = n.p >> 1 WHERE n.fits AND NOT coalesce(up.fits, FALSE))
SELECT r.doc_id, r.n_bytes, CAST(leaf.d AS INTEGER) AS depth, CASE WHEN leaf.d = 0 THEN '' ELSE right(lpad(bin(leaf.p), 64, '0'), CAST(leaf.d AS INTEGER)) END AS shard, CAST(leaf.b AS BIGINT) AS shard_bytes, leaf.c AS shard_rows, leaf.b > 1048576 AS oversize
FROM r JOIN leaf ON leaf.p = r.h >> CAST(60 - leaf.d AS INTEGER)
"""

MERKLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda crc, byte: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295) AS crc
  FROM documents),
leaf AS (SELECT doc_id, lang, sha256(head || n || tail) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || n || tail) END AS changed FROM f),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaf)),
base AS (SELECT l.*, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS i, count(*) OVER (PARTITION BY g.tree) AS n FROM leaf l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
up(tree, lvl, i, d, n) AS (SELECT tree, 0, i, leaf, n FROM base UNION ALL SELECT tree, lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
sub AS (SELECT tree, lvl AS h, d FROM up WHERE n = 1),
crown(lvl, i, d, n) AS (SELECT 0, tree, d, (SELECT count(*) FROM sub) FROM sub UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n),
step AS (
  SELECT b.tree, b.i AS pos, u.lvl, coalesce(s.d, '') AS d, u.i % 2 = 1 AS before FROM base b JOIN up u ON u.tree = b.tree AND u.i = b.i >> CAST(u.lvl AS INTEGER) AND u.n > 1 LEFT JOIN up s ON s.tree = u.tree AND s.lvl = u.lvl AND s.i = xor(u.i, 1)
  UNION ALL SELECT b.tree, b.i, t.h + c.lvl, coalesce(s.d, ''), c.i % 2 = 1 FROM base b JOIN sub t ON t.tree = b.tree JOIN crown c ON c.i = b.tree >> CAST(c.lvl AS INTEGER) AND c.n > 1 LEFT JOIN crown s ON s.lvl = c.lvl AND s.i = xor(c.i, 1)),
path AS (SELECT tree, pos, list({'l': CASE WHEN before THEN d ELSE '' END, 'm': '', 'r': CASE WHEN before THEN '' ELSE d END} ORDER BY lvl) AS p, string_agg(d, '' ORDER BY lvl) AS proof FROM step GROUP BY tree, pos),
done AS (
  SELECT b.doc_id, b.leaf, t.d AS subroot, c.d AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(coalesce(p.p, []), lambda x, y: {'l': '', 'm': sha256(y.l || x.m || y.r), 'r': ''}, {'l': '', 'm': b.changed, 'r': ''}).m AS folded_root
  FROM base b JOIN sub t ON t.tree = b.tree JOIN crown c ON c.n = 1 LEFT JOIN path p ON p.tree = b.tree AND p.pos = b.i)
SELECT *, folded_root = root AS verified FROM done
"""
