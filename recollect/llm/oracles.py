"""DuckDB counterparts of the training-data queries whose results SQL can express.

They assume ids that are neither null nor repeated, as in the given tables; everything else holds for any text.
"""

# Exact: sets that share 80 % have one of their rarest (n - ceil(0.8 n) + 1) shingles in common, so only pairs that do
# are counted out. Equal sets are one class; the smallest id reachable spreads along links to larger ids.
NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s
  FROM split
), classes AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT id, n, unnest(s) AS x FROM classes
), ranked AS (
  SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY df, x) AS r
  FROM (SELECT id, n, x, count(*) OVER (PARTITION BY x) AS df FROM items)
), rare AS (
  SELECT id, n, x FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1
), candidates AS (
  SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb
  FROM rare a JOIN rare b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (
    SELECT c.a, c.b, c.na + c.nb AS total, count(*) AS shared
    FROM candidates c JOIN items i ON i.id = c.a JOIN items j ON j.id = c.b AND j.x = i.x
    GROUP BY c.a, c.b, c.na, c.nb)
  WHERE 100 * shared >= 80 * (total - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS root FROM (SELECT DISTINCT a FROM edges)
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id AND r.root < e.b
), roots AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, c.id, s.doc_id) AS component_id,
  s.doc_id = coalesce(r.root, c.id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN roots r ON r.id = c.id
"""

# Every string of 50 bytes of the table, as hexadecimal digits; texts are cut in overlapping blocks first, since a
# substring far inside a long text is slow to reach.
SUFFIX_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 1049) AS b
  FROM (SELECT doc_id, h, unnest(range(0, n - 49, 1000)) AS base FROM docs)
), strings AS (
  SELECT doc_id, base + i AS p, substr(b, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, base, b, unnest(range(0, least(1000, len(b) // 2 - 49))) AS i FROM blocks)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), lost AS (
  SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE doc_id > first
), runs AS (
  SELECT doc_id, min(p) AS start, max(p) + 50 AS stop
  FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM lost))
  GROUP BY doc_id, run
), bounds AS (
  SELECT doc_id, start, stop FROM runs UNION ALL SELECT doc_id, n, n FROM docs
), pieces AS (
  SELECT doc_id, start, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start, stop) AS after FROM bounds
), kept AS (
  SELECT doc_id, sum(stop - start) AS gone, count(*) - 1 AS spans, string_agg(substr(h, 2 * after + 1, 2 * (start - after)), '' ORDER BY start, stop) AS k
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs JOIN kept USING (doc_id)
"""

ORACLES = {"op8_near_duplicates": NEAR_DUPLICATES, "op10_suffix_dedup": SUFFIX_DEDUP}
