"""The registered queries of the subpackage and their SQL."""

from sectorscope.llm.queries import (  # noqa: F401
    chat,
    decontaminate,
    line_dedup,
    merkle,
    near_dup,
    packing,
    quality,
    sharding,
    substring_dedup,
    tokens,
    url_filter,
    warc,
    whitening,
)
from sectorscope.llm.queries.registry import ORACLES, QUERIES  # noqa: F401
