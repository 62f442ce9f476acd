"""DuckDB SQL for the queries that SQL can express."""

#: Three-word stupid backoff; a document's own n-grams do not count for it.
OP1 = """
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), grams AS (
  SELECT doc_id, i, w, lag(w) OVER d AS p, lag(w, 2) OVER d AS q, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, p, q, n, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS c2,
         count(*) OVER (PARTITION BY q, p, w) - count(*) OVER (PARTITION BY doc_id, q, p, w) AS c3
  FROM grams
), near AS (
  SELECT *, lag(c1) OVER d AS x1, lag(c2) OVER d AS x2 FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), s1 AS (SELECT *, greatest(c1, 1) / greatest(n, 1) AS s FROM near
), s2 AS (SELECT * REPLACE (CASE WHEN p IS NULL THEN s WHEN c2 > 0 THEN c2 / x1 ELSE 0.4::DOUBLE * s END AS s) FROM s1
), s3 AS (SELECT * REPLACE (CASE WHEN q IS NULL THEN s WHEN c3 > 0 THEN c3 / x2 ELSE 0.4::DOUBLE * s END AS s) FROM s2
), scored AS (SELECT doc_id, count(*) AS n_tokens, sum(ln(s)) / count(*) AS score FROM s3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, round(score, 6) AS score FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id
"""

OP3 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
  FROM words WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other
), named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named m ON m.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6 = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][turn % 3 + 1]::DOUBLE AS w, 2 * source_size / [5, 2, 1][turn % 3 + 1]::DOUBLE AS cap FROM totals
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(2 * sum(source_size) OVER (ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), unit AS (
  SELECT arg_min(level, turn_by_cap) AS unit
  FROM (SELECT level, cap, row_number() OVER (ORDER BY cap, source) AS turn_by_cap FROM leveled) WHERE level <= cap
), shares AS (
  SELECT source, source_size, least(w * unit, 2.0::DOUBLE * source_size) AS target FROM leveled, unit
), quotas AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota FROM shares
), placed AS (
  SELECT s.doc_id, s.source, s.size, q.source_size, q.target, q.quota,
         (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), need AS (
  SELECT source, (quota + 255) // 256 AS need,
         (sum((quota + 255) // 256) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upper FROM quotas WHERE quota > 0
), whole AS (SELECT sum(need)::BIGINT AS slots FROM need
), points AS (SELECT unnest(range(1, slots + 1)) AS slot, slots FROM whole
), mapped AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN need ON floor((slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE)) * slots) < upper
       AND floor((slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE)) * slots) >= upper - need
), got AS (SELECT source, count(*) AS n FROM mapped GROUP BY source
), scheduled AS (
  SELECT source, rank, slot FROM mapped WHERE rank < need
  UNION ALL
  SELECT need.source, unnest(range(coalesce(n, 0), need)), slots + 1 FROM need LEFT JOIN got ON need.source IS NOT DISTINCT FROM got.source, whole
), passes AS (
  SELECT doc_id, source, quota, start + pass * source_size AS first, least(quota, start + pass * source_size + size) AS stop
  FROM placed, (VALUES (0), (1)) p(pass) WHERE size > 0 AND start + pass * source_size < quota
), spread AS (SELECT doc_id, source, stop - first AS take, unnest(range(first // 256, (stop - 1) // 256 + 1)) AS rank, first FROM passes
), slotted AS (
  SELECT doc_id, min(slot) AS first_slot, max(slot) AS last_slot
  FROM spread s JOIN scheduled c ON s.source IS NOT DISTINCT FROM c.source AND s.rank = c.rank GROUP BY doc_id
), taken AS (SELECT doc_id, sum(stop - first)::BIGINT AS taken FROM passes GROUP BY doc_id)
SELECT placed.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot
FROM placed LEFT JOIN taken ON taken.doc_id = placed.doc_id LEFT JOIN slotted ON slotted.doc_id = placed.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_backoff_scores": OP1, "op3_near_copies": OP3, "op5_digest_index": OP5, "op6_source_mix": OP6}
