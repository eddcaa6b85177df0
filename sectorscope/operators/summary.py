"""Summaries of a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.functions.text import preview
from sectorscope.operators import dims


def prediction_distribution(scored: DataFrame, code: str = "predicted_naics") -> DataFrame:
    """Rows per predicted code, most frequent first; ties by code."""
    return scored.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(code))


def scoring_summary(scored: DataFrame, top: int = 10, code: str = "predicted_naics") -> DataFrame:
    """Total rows, mean confidence and the most frequent codes with share and name.

    One pass: totals are rolled up from the per-code counts, which has one row per class.
    """
    counts = scored.groupBy(code).agg(F.count("*").alias("n"), F.sum("confidence").alias("_sum"))
    everyone = Window.partitionBy()
    ranked = (
        counts.withColumn("total", F.sum("n").over(everyone))
        .withColumn("mean_confidence", F.sum("_sum").over(everyone) / F.col("total"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(code))))
        .where(F.col("rank") <= top)
        .withColumn("pct", F.col("n") / F.col("total") * 100)
    )
    named = dims.batch_description(ranked, code, "industry")
    return named.select("total", "mean_confidence", "rank", code, "industry", "n", "pct")


def sample_preview(scored: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """First rows with name, prediction, confidence and description, as far as present."""
    wanted = ("name_repo", "predicted_naics", "confidence", "naics_description")
    rows = scored.orderBy(order_by) if order_by else scored
    return rows.select(*[c for c in wanted if c in scored.columns]).limit(n)


def text_preview(scored: DataFrame, text: str = "text", n: int = 100) -> DataFrame:
    """Shortened text next to prediction and confidence."""
    return scored.withColumn(text, preview(F.col(text), n))
