"""Whitened embeddings.  Eigenvectors have no SQL."""

from __future__ import annotations

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.whitening import whiten


@query()
def op11_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
