"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Documents as words: A-Z lower-cased, split at ASCII white space.
WORDS = r"""
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents)"""

SHINGLES = """
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s
  FROM w)"""

CONTAINMENT = f"""
WITH {WORDS}, {SHINGLES},
iw AS ({WORDS.split("AS (", 1)[1].rsplit(")", 1)[0].replace("doc_id", "item_id").replace("documents", "benchmark")}),
ish AS ({SHINGLES.split("AS (", 1)[1].rsplit(")", 1)[0].replace("doc_id", "item_id").replace("FROM w", "FROM iw")}),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sh JOIN ish USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

PARITY_JOIN = f"""
WITH RECURSIVE {WORDS}, {SHINGLES},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.x, edge.b FROM reach JOIN edge ON edge.a = reach.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

#: Lines of later copies: every shortest window of 50 words, from the left and from the right.
LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, upto - words AS before FROM l),
win AS (
  SELECT a.doc_id, a.pos AS start, min(b.pos) AS stop FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.before + 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos), b.pos FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND a.before <= b.upto - 50 GROUP BY b.doc_id, b.pos),
texts AS (
  SELECT win.doc_id, start, stop, array_to_string(string_split(d.text, chr(10))[start:stop], chr(10)) AS t
  FROM win JOIN documents d USING (doc_id)),
later AS (
  SELECT doc_id, start, stop FROM texts
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM later)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_deleted, 0) AS BIGINT) AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
"""

#: A node is the list of its turns; crc32 goes bit by bit over the digits of the number.
PREFIX_TRIE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, own, CAST(xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) AS BIGINT) % 4 AS h
  FROM l),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path
  FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (
  SELECT conv_id, d AS depth, path[1:d] AS node, len(path) = d AS ending
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '') AS ends
  FROM m GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.node[-1].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
s AS (
  SELECT node[1:a] AS node, a AS depth, CAST(sum(saved) AS BIGINT) AS saved_tokens, count_if(n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.node = v.node
LEFT JOIN n p ON p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]
"""
