"""What the operators share: row keys and the words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.operators.sizing import settle

# Keys of 8 bytes that are broadcast at most, which is some 30 MB in an executor.
MAX_KEYS = 1_000_000

# Word separators, as characters and as Java regular expressions.
SPACES = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of anything but space, tab, line feed, VT, FF and CR."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def quoted(name: str) -> str:
    """A column name as it is, with dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def content_key(*columns: Column) -> Column:
    """64-bit key of what a row holds; always compared together with the row's id."""
    return F.xxhash64(*columns)


def with_keys(rows: DataFrame, keys: DataFrame, on: str, max_keys: int = MAX_KEYS) -> DataFrame:
    """The rows whose number ``on`` is among ``keys`` (one column, distinct numbers).

    Runs a job that counts the keys: up to ``max_keys`` are broadcast, so that the rows stay where
    they are; more are joined by shuffle, with the same result.
    """
    side, few = settle(keys, max_keys)
    return rows.join(F.broadcast(side) if few else side, on, "left_semi")


def keep_rows(docs: DataFrame, verdict: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose (first of ``columns``, key of
    all ``columns``) is in ``verdict`` (``_id``, ``_key``).

    Rows that agree in ``columns`` share their fate; nulls are equal to nulls.
    """
    left = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"),
        F.col(columns[0]).alias("_id"),
        content_key(*[F.col(c) for c in columns]).alias("_key"),
    ).alias("l")
    right = verdict.select("_id", "_key").alias("r")
    same = (F.col("l._key") == F.col("r._key")) & F.col("l._id").eqNullSafe(F.col("r._id"))
    return left.join(right, same, "left_semi").select("_row.*")
