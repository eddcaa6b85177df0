"""Near-duplicates among documents."""

from __future__ import annotations

from sectorscope.llm.near_dup import near_duplicates
from sectorscope.llm.queries.registry import query, table


@query()
def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_id", "_key")
