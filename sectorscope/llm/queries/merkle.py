"""Merkle manifest of the documents, with a tampered seventh."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorscope.llm import merkle
from sectorscope.llm.queries.registry import query, table

# Where this divides the CRC-32 of the id, the check finds one character more than there was.
TAMPER = 7

# SQL has no CRC-32: eight shifts for each byte of the id.
SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
         list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
           lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT) FOR i IN range(8)],
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS crc
  FROM documents
), hashed AS (
  SELECT rid, doc_id, lang, coalesce(xor(crc, 4294967295) % {TAMPER} = 0, false) AS bad,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM docs
), leaves AS (
  SELECT rid, doc_id, lang, sha256(head || chars || tail) AS leaf,
         CASE WHEN bad THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS changed
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS n,
         count(*) OVER (PARTITION BY lang) AS size FROM leaves
), nodes AS (
  SELECT lang, CAST(0 AS BIGINT) AS lev, CAST(n AS BIGINT) AS n, CAST(size AS BIGINT) AS size, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lev + 1, n // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY n))
  FROM nodes WHERE size > 1 GROUP BY lang, lev, n // 2
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS n, count(*) OVER () AS size
  FROM nodes WHERE size = 1
), tops AS (
  SELECT CAST(0 AS BIGINT) AS lev, CAST(n AS BIGINT) AS n, CAST(size AS BIGINT) AS size, h FROM subroots
  UNION ALL
  SELECT lev + 1, n // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY n))
  FROM tops WHERE size > 1 GROUP BY lev, n // 2
), root AS (
  SELECT h AS root FROM tops WHERE size = 1
), steps AS (
  SELECT p.rid, k.lev, xor(p.n >> k.lev, 1) > (p.n >> k.lev) AS own_first, s.h
  FROM placed p JOIN (SELECT DISTINCT lang, lev FROM nodes WHERE size > 1) k ON p.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lev = k.lev AND s.n = xor(p.n >> k.lev, 1)
  UNION ALL
  SELECT p.rid, 100 + k.lev, xor(r.n >> k.lev, 1) > (r.n >> k.lev), s.h
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  CROSS JOIN (SELECT DISTINCT lev FROM tops WHERE size > 1) k
  LEFT JOIN tops s ON s.lev = k.lev AND s.n = xor(r.n >> k.lev, 1)
), proofs AS (
  SELECT rid, string_agg(coalesce(h, ''), '' ORDER BY lev) AS siblings,
         list(coalesce(CASE WHEN own_first THEN '>' ELSE '<' END || h, '-') ORDER BY lev) AS way
  FROM steps GROUP BY rid
), folds AS (
  SELECT p.rid, list_reduce([changed] || coalesce(way, []), lambda x, y: sha256(
           CASE y[1] WHEN '-' THEN x WHEN '>' THEN x || y[2:] ELSE y[2:] || x END)) AS folded_root
  FROM placed p LEFT JOIN proofs USING (rid)
)
SELECT p.doc_id, p.leaf, r.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
LEFT JOIN proofs q ON p.rid = q.rid JOIN folds f ON p.rid = f.rid
"""


@query(SQL)
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    more = F.when(crc % TAMPER == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, tampered={"n_chars": more})
    text = merkle.digest_text
    return found.select(
        "doc_id",
        text(F.col("leaf")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        text(F.col("root")).alias("root"),
        F.sha2(merkle.proof_texts(F.col("proof")), 256).alias("proof_sha256"),
        merkle.folded(text(F.col("changed")), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
