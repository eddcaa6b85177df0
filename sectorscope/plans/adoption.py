"""Adoption of several tools by month and industry."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.operators import adoption as ad
from sectorscope.sources.paths import store
from sectorscope.sources.readers import event_reader, read_first_use, read_parquet, read_tools
from sectorscope.sources.writers import write_first_use


def tool_adoption(events: DataFrame, predictions: DataFrame, repo: str, time: str, tool: str = "tool") -> DataFrame:
    """Monthly counts of all tools in one pass over an event table with a tool column."""
    first = ad.first_use(events, repo, time, by=[tool])
    return ad.monthly_adoption(first, predictions, by=[tool])


def stack_tools(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """One table with a ``tool`` column; a tool without data is left out with a warning."""
    for tool, table in tables.items():
        if table is None:
            warnings.warn(f"No event data for {tool}; it is left out", stacklevel=2)
    parts = [table.withColumn("tool", F.lit(tool)) for tool, table in tables.items() if table is not None]
    if not parts:
        raise ValueError("No tool has event data")
    return reduce(DataFrame.unionByName, parts)


def _warned(missing: list[str]) -> None:
    for tool in missing:
        warnings.warn(f"No event data for {tool}; it is left out", stacklevel=3)


def _scored_readers(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, Callable[..., DataFrame]]:
    """A reader for each tool's scored table; tables of one schema share one."""
    readers: dict[str, Callable[..., DataFrame]] = {}
    by_schema: dict[str, Callable[..., DataFrame]] = {}
    for tool, path in paths.items():
        kinds = ad.repo_codes(read_parquet(spark, path)).schema
        load = spark.read.schema(kinds).parquet
        readers[tool] = by_schema.setdefault(kinds.json(), lambda some, load=load: load(*some))
    return readers


def adoption_report(
    spark: SparkSession,
    events: Mapping[str, str],
    predictions: Mapping[str, str],
    computed: tuple[str, ...] = (),
    first_use_dir: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Monthly counts per tool from files; every tool has its own scored table.

    ``computed`` names the tools whose file already holds first-use dates; the others are
    extracted from event lines and, with ``first_use_dir``, stored there.  Without ``strict``
    broken event lines are passed over; ``readers.observed_events`` counts them.

    All event files are one scan, whatever the number of tools, and so are scored tables of one schema.
    A tool without an event file is left out with a warning.
    """
    load = event_reader(spark, strict)
    lines = {tool: path for tool, path in events.items() if tool not in computed}
    found, missing = read_tools(dict.fromkeys(lines, load), lines)
    _warned(missing)
    ready = {tool: read_first_use(spark, events[tool]) for tool in events if tool in computed}
    tools = [tool for tool in events if tool not in missing]
    if not tools:
        raise ValueError("No tool has event data")
    parts = [stack_tools(ready).select("tool", "nwo", "first_use_date")] if ready else []
    if found is not None:
        extracted = ad.first_use(found, by=["tool"])
        if first_use_dir:
            extracted = store(extracted, "first-use")
            for tool in set(lines) - set(missing):
                own = extracted.where(F.col("tool") == tool).drop("tool")
                write_first_use(own, f"{first_use_dir}/{tool}_first_use.parquet")
        parts.append(extracted.select("tool", "nwo", "first_use_date"))
    first = reduce(DataFrame.unionByName, parts)
    wanted = {tool: predictions[tool] for tool in tools}
    scored, absent = read_tools(_scored_readers(spark, wanted), wanted)
    if absent:
        raise FileNotFoundError(f"Data file not found: {wanted[absent[0]]}")
    return ad.monthly_adoption(first, scored, by=["tool"], on=["tool", "nwo"])
