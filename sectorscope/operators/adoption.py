"""Adoption of a tool: first use per repository, then counts by month and industry.

``by`` columns (for example the tool) carry several groups through one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.operators import dims
from sectorscope.operators.sizing import hot_key_join

CODE = "predicted_naics"
MAX_COLUMNS = 2_000


def first_use(
    events: DataFrame, repo: str = "repo_nwo", time: str = "created_at", by: Sequence[str] = ()
) -> DataFrame:
    """Earliest event per repository; the minimum is taken before the shuffle as well."""
    return (
        events.where(F.col(repo).isNotNull())
        .groupBy(*by, F.col(repo).alias("nwo"))
        .agg(F.min(time).alias("first_use_date"))
    )


def repo_codes(predictions: DataFrame, code: str = CODE) -> DataFrame:
    """Only what adoption needs of a scored table."""
    return predictions.select("nwo", F.col(code).alias(CODE))


def merge_predictions(first: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner join on the repository; a repository scored twice appears twice.

    Repositories that dominate the scored table are spread over tasks.  Runs a job to find them;
    :func:`monthly_adoption` needs none, as it counts repeated predictions before the join.
    """
    rows = repo_codes(predictions).where(F.col("nwo").isNotNull())
    joined = hot_key_join(rows, first.where(F.col("nwo").isNotNull()), "nwo")
    return joined.select(*[c for c in first.columns], CODE)


def utc_month(df: DataFrame, time: str) -> Column:
    """First day of the month in UTC, whatever the session time zone is."""
    if isinstance(df.schema[time].dataType, T.TimestampType):
        day = F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))
    else:
        day = F.col(time).cast("date")
    return F.trunc(day, "MM")


def by_month_and_industry(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form of the monthly table: ``(month, predicted_naics, n)``; null keys are dropped."""
    rows = merged.withColumn("month", utc_month(merged, "first_use_date"))
    return (
        rows.where(F.col("month").isNotNull() & F.col(CODE).isNotNull())
        .groupBy(*by, "month", CODE)
        .agg(F.count("*").alias("n"))
    )


def monthly_adoption(
    first: DataFrame, predictions: DataFrame, by: Sequence[str] = (), on: Sequence[str] = ("nwo",)
) -> DataFrame:
    """Same counts straight from first use and predictions.

    Repeated predictions are counted before the join, so no repository brings more than one
    row per code into it.  ``on`` adds the tool where every tool has its own predictions.
    """
    scored = (
        predictions.where(F.col("nwo").isNotNull() & F.col(CODE).isNotNull())
        .groupBy(*on, CODE)
        .agg(F.count("*").alias("_rows"))
    )
    dated = first.withColumn("month", utc_month(first, "first_use_date")).where(F.col("month").isNotNull())
    return dated.join(scored, list(on)).groupBy(*by, "month", CODE).agg(F.sum("_rows").alias("n"))


def month_by_industry(monthly: DataFrame, codes: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Wide form: one row per month in order, one column per code, 0 where nothing happened.

    ``codes`` come first, whether they occur or not; every other code that occurs follows, so
    the wide table counts what the long one counts.  Runs a job to find them.
    """
    columns = list(dict.fromkeys([*codes, *codes_present(monthly)]))
    wide = monthly.groupBy(*by, "month").pivot(CODE, columns).agg(F.sum("n"))
    return wide.na.fill(0, columns).orderBy(*by, "month")


def codes_present(monthly: DataFrame) -> list[str]:
    """Codes that occur, in order; more than a table can have as columns is an error."""
    found = monthly.select(CODE).distinct().orderBy(CODE).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"More than {MAX_COLUMNS} codes for a wide table")
    return [r[0] for r in found]


def industry_totals(monthly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total per industry, largest first; ties by code."""
    totals = monthly.groupBy(*by, CODE).agg(F.sum("n").alias("n"))
    return totals.orderBy(*by, F.desc("n"), F.asc(CODE))


def adoption_summary(monthly: DataFrame, top: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Date range, total and the largest industries with their names.

    The windows see one row per class.
    """
    totals = monthly.groupBy(*by, CODE).agg(
        F.sum("n").alias("n"), F.min("month").alias("_first"), F.max("month").alias("_last")
    )
    group = Window.partitionBy(*by)
    ranked = (
        totals.withColumn("first_month", F.min("_first").over(group))
        .withColumn("last_month", F.max("_last").over(group))
        .withColumn("total_repos", F.sum("n").over(group))
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), F.asc(CODE))))
        .where(F.col("rank") <= top)
    )
    named = dims.short_description(ranked, CODE, "industry", default="Unknown")
    return named.select(*by, "first_month", "last_month", "total_repos", "rank", CODE, "industry", "n")


def top_industries(monthly: DataFrame, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Monthly counts of the ``top`` industries by total; all others are summed as ``Other``.

    Months without any of the others get no ``Other`` row here; the wide form shows 0.
    The windows see one row per month and class.
    """
    per_code = Window.partitionBy(*by, CODE)
    totals = monthly.withColumn("_total", F.sum("n").over(per_code))
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("_total"), F.asc(CODE)))
    group = F.when(rank <= top, F.col(CODE)).otherwise(F.lit("Other"))
    grouped = totals.withColumn("industry", group)
    return grouped.groupBy(*by, "month", "industry").agg(F.sum("n").alias("n"))


def chart_series(monthly: DataFrame, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the stacked chart: month, series label, count."""
    return dims.series_label(top_industries(monthly, top, by), "industry").select(*by, "month", "series", "n")


def chart_table(monthly: DataFrame, top: int = 10) -> DataFrame:
    """Wide chart table: months in order, the ``top`` series by total, then ``Other``.

    At most ``top + 1`` series names are fetched to name the columns.
    """
    series = chart_series(monthly, top)
    names = series.groupBy("series").agg(F.sum("n").alias("n"))
    order = names.orderBy(F.col("series") == "Other", F.desc("n"), F.asc("series")).collect()
    columns = [r["series"] for r in order]
    wide = series.groupBy("month").pivot("series", columns).agg(F.sum("n"))
    return wide.na.fill(0).orderBy("month")
