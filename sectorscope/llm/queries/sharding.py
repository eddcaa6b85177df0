"""Shards of bounded size over documents."""

from __future__ import annotations

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.sharding import assign_shards

# 1 MiB, so that tables of every size here need more than one shard.
MAX_BYTES = 1 << 20

SQL = rf"""
WITH keys AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')), 1, 15)
              AS BIGINT) AS k
  FROM documents
), paths AS (
  SELECT rid, doc_id, n_bytes, k, d, k >> (60 - d) AS p FROM keys, (SELECT CAST(range AS BIGINT) AS d FROM range(61))
), sizes AS (
  SELECT d, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM paths GROUP BY d, p
), leaves AS (
  SELECT rid, min(d) AS d FROM paths JOIN sizes USING (d, p)
  WHERE shard_bytes <= {MAX_BYTES} OR shard_docs = 1 GROUP BY rid
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(p), 64, '0'), CAST(d AS INT)) END AS shard,
       shard_bytes, shard_docs, shard_bytes > {MAX_BYTES} AS over_limit, CAST(d AS INT) AS depth
FROM leaves JOIN paths USING (rid, d) JOIN sizes USING (d, p)
"""


@query(SQL)
def op2_extendible_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), MAX_BYTES)
