"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, top) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.top FROM reach r JOIN pairs p ON p.a = r.node WHERE r.top < p.b),
c AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

LINE_DEDUP = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, lines FROM s),
l AS (SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM u),
o AS (SELECT k AS ok, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k),
d AS (SELECT l.*, coalesce(first_doc < doc_id, false) AS dropped FROM l LEFT JOIN o ON ok = k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

IMPORTANCE = f"""
WITH octets AS (
  SELECT list(c ORDER BY b) AS crc_of FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
found AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words),
counted AS (SELECT side, doc_id, feature, count(*) AS n FROM found GROUP BY ALL),
spelled AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (
  SELECT feature, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST(('0x' || substr(h, 2 * i - 1, 2)) AS BIGINT))),
    lambda c, b: xor(c // 256, crc_of[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, octets),
c AS (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM c WHERE side = 'd' GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM c WHERE side = 'b' GROUP BY bucket),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS ss, coalesce(sum(n) FILTER (side = 'b'), 0) AS tt FROM c),
gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
w AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM c JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g
  FROM words d LEFT JOIN w ON w.doc_id = d.doc_id WHERE side = 'd'),
eligible AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + g DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + g AS BIGINT) AS score,
  CASE WHEN r <= 25 * e.n // 100 THEN r END AS rank
FROM scored s LEFT JOIN eligible e ON e.doc_id = s.doc_id
"""
