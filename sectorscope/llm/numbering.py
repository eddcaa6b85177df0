"""Rows numbered without gaps from 0, in the whole table or in each group, without one task seeing all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.sources.paths import store

# monotonically_increasing_id holds the partition above this many bits.
_ROW_BITS = 33


def numbered(df: DataFrame, name: str, group: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``_n`` (place in its group, from 0) and ``_size`` (rows of the group).

    With ``order`` the rows are range-partitioned by group and order, so a group of any size is
    spread over tasks; without one, and without groups, they are numbered where they are.  Runs
    a job: the rows are stored, and only counts by partition and group meet.
    """
    group = group or []
    ordered = df.orderBy(*[F.col(g).asc_nulls_first() for g in group], *order) if order else df
    rows = store(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    # As many rows as partitions and groups together: a partition holds a range.
    whole = Window.partitionBy(*group)
    places = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
        "_first",
        (F.sum("_c").over(whole.orderBy("_part")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(whole).alias("_size"),
    )
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]]
    found = rows.join(places, reduce(Column.__and__, same))
    return found.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_n"), "_size")
