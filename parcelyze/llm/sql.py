"""DuckDB SQL with the rows of those queries of this folder that SQL can express on whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Documents' words as a list, numbered rows.
CONTAMINATION = (
    r"""
WITH b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all("""
    + _LOWER.format("text")
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all("""
    + _LOWER.format("coalesce(text, '')")
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw USING (n, run)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
)

MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, source_size, weight, source_size * CAST(2 AS DOUBLE) AS most FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
    FROM d GROUP BY source)),
l AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER a, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0)) AS level
  FROM s WINDOW a AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
    ELSE max(CASE WHEN most <= level * weight THEN NULL ELSE level END) OVER () * weight END AS target FROM l),
r AS (
  SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS n,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    CAST(CAST('0x' || substr(md5('1:' || coalesce('=' || d.source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(drawn + each * n) - floor(drawn + each * (n - 1)), ceil(each)) AS BIGINT) * size AS taken FROM r
"""
