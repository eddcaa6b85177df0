"""Code dimension lookups.  The dimension has 27 fixed rows, so every join is a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.functions.codes import sector_dim
from sectorscope.functions.text import strip


def _with_description(df: DataFrame, code: str, desc: str, out: str, trim: bool) -> DataFrame:
    dim = sector_dim(df.sparkSession).select(F.col("code").alias("_code"), F.col(desc).alias(out))
    key = strip(F.col(code)) if trim else F.col(code).cast("string")
    return df.withColumn("_key", key).join(F.broadcast(dim), F.col("_key") == F.col("_code"), "left").drop("_key", "_code")


def describe_codes(df: DataFrame, code: str = "code", out: str = "naics_description") -> DataFrame:
    """Add the long description of the trimmed code; null when unknown."""
    return _with_description(df, code, "long_desc", out, trim=True)


def add_descriptions(df: DataFrame, code: str = "code", out: str = "naics_description") -> DataFrame:
    """Add the long description by exact code, without trimming."""
    return _with_description(df, code, "long_desc", out, trim=False)


def unmapped_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Codes without a description and the number of rows that carry them."""
    dim = sector_dim(df.sparkSession).select(F.col("code").alias("_code"))
    rows = df.select(F.col(code).cast("string").alias(code)).groupBy(code).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left_anti")


def batch_description(df: DataFrame, code: str, out: str = "naics_description") -> DataFrame:
    """Medium description, ``Unknown`` for other codes."""
    named = _with_description(df, code, "medium_desc", out, trim=False)
    return named.withColumn(out, F.coalesce(F.col(out), F.lit("Unknown")))


def short_description(df: DataFrame, code: str, out: str = "short_desc", default: str | None = None) -> DataFrame:
    """Short description; unknown codes show ``default``, or themselves when it is None."""
    named = _with_description(df, code, "short_desc", out, trim=False)
    return named.withColumn(out, F.coalesce(F.col(out), F.lit(default) if default is not None else F.col(code)))


def series_label(df: DataFrame, code: str, out: str = "series") -> DataFrame:
    """Chart label ``code: short description``; the rest group ``Other`` stays as it is."""
    named = short_description(df, code, "_short")
    label = F.when(F.col(code) == "Other", F.lit("Other")).otherwise(F.concat_ws(": ", F.col(code), F.col("_short")))
    return named.withColumn(out, label).drop("_short")


def all_codes(spark: SparkSession) -> DataFrame:
    return sector_dim(spark).select("seq", "code", "long_desc")


def primary_codes(spark: SparkSession) -> DataFrame:
    return sector_dim(spark).where("is_primary").select("seq", "code")


def sectors(spark: SparkSession) -> DataFrame:
    return sector_dim(spark).where("is_sector").select("seq", "code", "long_desc")


def distinct_descriptions(dim: DataFrame) -> DataFrame:
    """One row per description with the first code in list order."""
    return (
        dim.groupBy(F.col("long_desc").alias("description"))
        .agg(F.min_by("code", "seq").alias("code"), F.min("seq").alias("seq"))
        .select("code", "description", "seq")
    )
