"""Quality rules over documents."""

from __future__ import annotations

from sectorscope.llm.quality import quality_rules
from sectorscope.llm.queries.registry import query, table

SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, '=' || source AS src, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rid, doc_id, coalesce(src, '') AS host, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw,
         list_filter(list_transform(string_split(regexp_replace(lower(t), '[0-9]+', '0', 'g'), chr(10)),
                                    lambda x: trim(x)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS normal
  FROM base
), tokens AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM parts
), triples AS (
  SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY i)
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid
), measures AS (
  SELECT p.rid, p.doc_id, p.host, p.t, p.normal,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM parts p LEFT JOIN covered c USING (rid)
), bodies AS (
  SELECT host, list_distinct(any_value(normal)) AS lines, min(doc_id) AS first_id FROM measures GROUP BY host, t
), spread AS (
  SELECT host, first_id, unnest(lines) AS line FROM bodies
), counts AS (
  SELECT host, line, count(*) AS n, min(first_id) AS first_id FROM spread GROUP BY host, line
), frequent AS (
  SELECT host, line, first_id FROM counts WHERE n > 20
), occurrences AS (
  SELECT rid, doc_id, host, unnest(normal) AS line FROM measures
), lost AS (
  SELECT o.rid, sum(length(o.line)) AS lost
  FROM occurrences o JOIN frequent f ON o.host = f.host AND o.line = f.line
  WHERE o.doc_id IS DISTINCT FROM f.first_id GROUP BY o.rid
), totals AS (
  SELECT rid, sum(length(line)) AS total FROM occurrences GROUP BY rid
), judged AS (
  SELECT m.*, CAST(coalesce(t.total, 0) AS BIGINT) AS line_chars, CAST(coalesce(l.lost, 0) AS BIGINT) AS frequent_chars,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM measures m LEFT JOIN totals t USING (rid) LEFT JOIN lost l USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, frequent_chars,
       NOT base_failed AND frequent_chars <= line_chars * CAST(0.7 AS DOUBLE) AS kept
FROM judged
"""


@query(SQL)
def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("_id", "_key")
