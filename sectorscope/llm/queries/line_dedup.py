"""Lines of documents that repeat an earlier line within one word."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorscope.llm.line_dedup import line_report
from sectorscope.llm.queries.registry import query, table

# Lines within one word edit: equal, or equal without the i-th word of either or both.  Lines of fewer than
# 6 words are compared whole, from 4 characters on.
SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), worded AS (
  SELECT doc_id, k, line,
         regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM lines
), compared AS (
  SELECT doc_id, k, w FROM worded
  WHERE len(w) >= 6 OR (len(w) > 0 AND length(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) >= 4)
), firsts AS (
  SELECT w, min((doc_id, k)) AS first_at FROM compared GROUP BY w
), heads AS (
  SELECT w, first_at FROM firsts WHERE len(w) >= 6
), variants AS (
  SELECT w, first_at, i, w[1:i - 1] || w[i + 1:] AS v
  FROM (SELECT w, first_at, unnest(generate_series(1, len(w))) AS i FROM heads)
), near AS (
  SELECT a.w, min(b.first_at) AS place FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i GROUP BY a.w
  UNION ALL
  SELECT a.w, min(b.first_at) FROM variants a JOIN heads b ON a.v = b.w GROUP BY a.w
  UNION ALL
  SELECT b.w, min(a.first_at) FROM variants a JOIN heads b ON a.v = b.w GROUP BY b.w
), floors AS (
  SELECT w, min(place) AS place FROM near GROUP BY w
  UNION ALL SELECT w, first_at FROM firsts WHERE len(w) < 6
), late AS (
  SELECT doc_id, k FROM compared l JOIN floors f ON l.w = f.w WHERE (doc_id, k) > f.place
), totals AS (
  SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS kept_text, count(*) AS n_kept
  FROM lines l ANTI JOIN late g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id
)
SELECT t.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM totals t LEFT JOIN kept USING (doc_id)
UNION ALL
SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), sha256('') FROM documents WHERE text IS NULL
"""


@query(SQL)
def op1_line_dedup(spark, sf_dir):
    report = line_report(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return report.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))
