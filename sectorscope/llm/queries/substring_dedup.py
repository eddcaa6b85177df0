"""Words of documents inside repeats of 35 words or more."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.substring_dedup import remove_repeats

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), starts AS (
  SELECT rid, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35
), windows AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM starts
), repeated AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS p FROM windows JOIN repeated USING (win)
), tokens AS (
  SELECT rid, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT rid, string_agg(token, ' ' ORDER BY p) AS kept_text, count(*) AS n_kept
  FROM tokens t ANTI JOIN covered c ON t.rid = c.rid AND t.p = c.p GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query(SQL)
def op8_substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
