"""Queries over the given tables, each next to the SQL it must agree with."""

from bindings import adoption, corpus, evaluation, industry, scoring, storage, text  # noqa: F401
from bindings.registry import ORACLES, QUERIES  # noqa: F401
