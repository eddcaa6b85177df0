"""Size-checked broadcasts and joins with hot keys.

A side is broadcast only after its rows were counted against a bound; beyond the bound the
same result comes from a shuffle join.  Rows of keys that hold a large share of the big side
are salted, so that no task gets all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.sources.paths import store

MAX_BROADCAST_ROWS = 100_000
# A key is hot from this share of the rows on, if that is at least so many rows.
HOT_SHARE = 1e-4
HOT_KEY_ROWS = 100_000
SALTS = 64


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows as a local relation, whose exact size the optimizer knows."""
    names = [part.split()[0] for part in schema.split(",")]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table(dict(zip(names, columns))), schema)


def settle(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Fetch a table that is expected to be small.

    Runs a job.  Returns ``(local copy, True)`` when it has at most ``max_rows`` rows, so that a
    broadcast is known to be safe; otherwise ``(stored copy, False)``.  Either way later uses do
    not compute it again.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return store(df, "settled"), False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def lookup_join(big: DataFrame, small: DataFrame, on: str, how: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key): broadcast when small, else by shuffle.

    Runs jobs: ``small`` is fetched to be counted, and beyond the bound hot keys are looked for.
    """
    side, is_small = settle(small, max_rows)
    if is_small:
        return big.join(F.broadcast(side), on, how)
    return hot_key_join(big, side, on, how)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int = HOT_KEY_ROWS) -> list:
    """Keys with at least ``share`` of all rows, and ``min_rows``; runs one job.

    Frequent items are found by a mergeable sketch in one pass, without a shuffle of the keys.
    At most ``1/share`` keys can be that frequent, and the sketch holds many more, so none is missed.
    """
    tracked = min(1_000_000, int(20 / share))
    sketch = F.expr(f"approx_top_k({key}, {int(1 / share) + 1}, {tracked})").alias("top")
    found = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), sketch).first()
    least = max(min_rows, found["n"] * share)
    return sorted(item["item"] for item in found["top"] or [] if item["count"] >= least)


def hot_key_join(
    big: DataFrame,
    other: DataFrame,
    key: str,
    how: str = "inner",
    share: float = HOT_SHARE,
    min_rows: int = HOT_KEY_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` to ``other``, which normally has one row per key, without gathering hot keys.

    Rows of hot keys get one of ``salts`` numbers and their partner rows all of them, so a hot key
    is spread over as many tasks; each row still meets each partner once.  Exact for inner,
    left, left_semi and left_anti, also where ``other`` repeats a key.  Runs one job.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"Unsupported join type: {how}")
    hot = hot_keys(big, key, share, min_rows)
    if not hot:
        return big.join(other, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    number = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = big.withColumn("_salt", F.when(is_hot, number).otherwise(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    partners = other.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(partners, [key, "_salt"], how).drop("_salt")
