"""Pages as WARC records, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.warc import archive_pages, base32

# SQL has no base32: the digits of the digest are looked up in its alphabet, 5 bits at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
     w AS (SELECT h, max(page_id) AS winner FROM d GROUP BY h),
     b AS (
       SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS INT), 10) AS BIGINT)
                          >> CAST(35 - 5 * (k % 8) AS INT)) & 31) AS INT), 1), '' ORDER BY k) AS payload_digest
       FROM (SELECT DISTINCT h FROM d), (SELECT range AS k FROM range(32)) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM d JOIN w USING (h) JOIN b USING (h)
"""


@query(SQL)
def op10_warc_archive(spark, sf_dir):
    records = archive_pages(table(spark, sf_dir, "pages"))
    held = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(held, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(held, base32(F.sha1("payload")))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
        .alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
    )
