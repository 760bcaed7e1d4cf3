"""SQL of the operators that SQL can express, for DuckDB on the same tables."""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), phrases AS (
  SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2),
    lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS sizes(m)
), counted AS (
  SELECT lang, m, phrase, count(*)::BIGINT AS a FROM phrases GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS words, a FROM counted WHERE m > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
  JOIN counted AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counted AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part
        FROM candidates WHERE m = 3) GROUP BY lang, part
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, encode(w.phrase)) AS rank
  FROM worst AS w LEFT JOIN inside AS i ON i.lang = w.lang AND i.part = w.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked AS r JOIN totals AS t ON t.lang = r.lang WHERE rank <= 2000
"""

MERKLE = r"""
WITH RECURSIVE nibbles(v) AS (  -- fixed values: CRC-32 of half a byte
  SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[]
), checked(id, pos, crc) AS (
  SELECT DISTINCT doc_id, 1, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, pos + 1, xor(low >> 4, v[(low & 15) + 1])
  FROM (SELECT id, pos, v, xor(x >> 4, v[(x & 15) + 1]) AS low
        FROM (SELECT id, pos, v, xor(crc, ascii(substr(id::VARCHAR, pos, 1))::BIGINT) AS x
              FROM checked, nibbles WHERE pos <= length(id::VARCHAR)))
), marked AS (
  SELECT id FROM checked WHERE pos > length(id::VARCHAR) AND xor(crc, 4294967295) % 7 = 0
), fields AS (
  SELECT doc_id, lang, doc_id IN (SELECT id FROM marked) AS forged, n_chars::HUGEINT AS chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS tail
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    sha256(head || CASE WHEN chars IS NULL THEN '-' ELSE length(chars::VARCHAR) || ':' || chars END || tail) AS leaf,
    sha256(head || CASE WHEN chars IS NULL THEN '-'
      ELSE length((chars + forged::INT)::VARCHAR) || ':' || (chars + forged::INT) END || tail) AS shown
  FROM (SELECT * REPLACE (coalesce(forged, false) AS forged) FROM fields)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS size,
    row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row_id
  FROM leaves
), lower_nodes(tree, level, place, digest, size) AS (
  SELECT tree, 0, place, leaf, size FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2
  FROM lower_nodes WHERE size > 1 GROUP BY tree, level, place // 2
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
  FROM lower_nodes WHERE size = 1
), upper_nodes(level, place, digest, size) AS (
  SELECT 0, place, subroot, size FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2
  FROM upper_nodes WHERE size > 1 GROUP BY level, place // 2
), climbed(row_id, tree, level, place, own, siblings) AS (
  SELECT row_id, tree, 0, place, shown, '' FROM placed
  UNION ALL
  SELECT c.row_id, c.tree, c.level + 1, c.place // 2, sha256(
      CASE WHEN s.digest IS NULL THEN c.own WHEN c.place % 2 = 1 THEN s.digest || c.own ELSE c.own || s.digest END),
    c.siblings || coalesce(s.digest, '')
  FROM climbed AS c
  JOIN lower_nodes AS o ON o.tree = c.tree AND o.level = c.level AND o.place = c.place AND o.size > 1
  LEFT JOIN lower_nodes AS s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
), topped(row_id, level, place, own, siblings) AS (
  SELECT c.row_id, 0, r.place, c.own, c.siblings
  FROM climbed AS c JOIN subroots AS r ON r.tree = c.tree
  JOIN lower_nodes AS o ON o.tree = c.tree AND o.level = c.level AND o.place = c.place AND o.size = 1
  UNION ALL
  SELECT c.row_id, c.level + 1, c.place // 2, sha256(
      CASE WHEN s.digest IS NULL THEN c.own WHEN c.place % 2 = 1 THEN s.digest || c.own ELSE c.own || s.digest END),
    c.siblings || coalesce(s.digest, '')
  FROM topped AS c
  JOIN upper_nodes AS o ON o.level = c.level AND o.place = c.place AND o.size > 1
  LEFT JOIN upper_nodes AS s ON s.level = c.level AND s.place = xor(c.place, 1)
)
SELECT n.doc_id, n.leaf, r.subroot, top.digest AS root, sha256(t.siblings) AS proof_sha256, t.own AS folded_root,
  t.own = top.digest AS verified
FROM placed AS n JOIN subroots AS r ON r.tree = n.tree
JOIN topped AS t ON t.row_id = n.row_id
JOIN upper_nodes AS top ON top.size = 1 AND t.level = top.level
"""

SQL = {"op11_collocations": COLLOCATIONS, "op12_merkle_manifest": MERKLE}
