"""Token counts over documents."""

from __future__ import annotations

import public_tokenizers

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.tokens import token_counts


@query()
def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
