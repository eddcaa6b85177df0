"""Sequences of at most 2048 tokens over documents."""

from __future__ import annotations

import public_tokenizers

from sectorscope.llm.packing import pack_documents
from sectorscope.llm.queries.registry import query, table

CAPACITY = 2048


@query()
def op5_packed_sequences(spark, sf_dir):
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end_id=0
    )
