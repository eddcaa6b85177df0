"""Length and class profiles.

Texts are read once and reduced to a length frequency table (one row per distinct length),
which is stored; every statistic below is computed exactly from the stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.sources.paths import store


def length_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(length, n)``; null texts are left out."""
    lengths = df.select(F.length(text).alias("length")).where(F.col("length").isNotNull())
    return lengths.groupBy("length").agg(F.count("*").alias("n"))


def store_length_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Length counts in the shared folder, so that several statistics cost one text scan."""
    return store(length_counts(df, text), "lengths")


def length_range(counts: DataFrame) -> DataFrame:
    """Minimum, maximum and mean length."""
    return counts.agg(
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        (_weighted(F.col("length")) / F.sum("n")).alias("mean_length"),
    )


def _weighted(x: Column) -> Column:
    return F.sum(x.cast("double") * F.col("n"))


def length_stats(counts: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, exact median and sample standard deviation."""
    total = F.sum("n")
    mean = _weighted(F.col("length")) / total
    centre = counts.select(mean).scalar()
    spread = _weighted(F.pow(F.col("length") - centre, F.lit(2)))
    return counts.agg(
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        mean.alias("mean_length"),
        F.percentile("length", 0.5, F.col("n")).alias("median_length"),
        F.when(total > 1, F.sqrt(spread / F.nullif(total - 1, F.lit(0)))).alias("std_length"),
    )


def length_histogram(counts: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, all of them, the last one closed.

    A length belongs to the bin whose floating-point edges enclose it.  When all lengths are
    equal the range is widened by a half on both sides.
    """
    lo, hi = counts.select(F.min("length")).scalar(), counts.select(F.max("length")).scalar()
    flat = counts.select((F.min("length") == F.max("length")).alias("flat")).scalar()
    start = F.when(flat, lo - 0.5).otherwise(lo.cast("double"))
    stop = F.when(flat, hi + 0.5).otherwise(hi.cast("double"))
    spark = counts.sparkSession

    placed = counts.withColumn("_lo", start).withColumn("_step", (stop - start) / bins)
    guess = F.least(F.floor((F.col("length") - F.col("_lo")) / F.col("_step")), F.lit(bins - 1)).cast("int")
    lower = F.col("_lo") + F.col("_guess") * F.col("_step")
    upper = F.col("_lo") + (F.col("_guess") + 1) * F.col("_step")
    exact = (
        F.when(F.col("length") < lower, F.col("_guess") - 1)
        .when((F.col("length") >= upper) & (F.col("_guess") < bins - 1), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    filled = placed.withColumn("_guess", guess).groupBy((exact + 1).alias("bin")).agg(F.sum("n").alias("_n"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (stop - start) / bins
    return frame.join(filled, "bin", "left").select(
        "bin",
        (start + (F.col("bin") - 1) * width).alias("lower"),
        F.when(F.col("bin") == bins, stop).otherwise(start + F.col("bin") * width).alias("upper"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def _quartiles(counts: DataFrame) -> DataFrame:
    q = F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    box = counts.agg(q.alias("q")).select(
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return box.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)


def box_numbers(counts: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last data points within 1.5 IQR, number of outliers."""
    box = _quartiles(counts)
    low, high = box.select("_low").scalar(), box.select("_high").scalar()
    inside = (F.col("length") >= low) & (F.col("length") <= high)
    ends = counts.agg(
        F.min(F.when(inside, F.col("length"))).alias("_w1"),
        F.max(F.when(inside, F.col("length"))).alias("_w2"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
    )
    q1, median, q3 = (box.select(c).scalar() for c in ("q1", "median", "q3"))
    return ends.select(
        q1.alias("q1"),
        median.alias("median"),
        q3.alias("q3"),
        F.least(F.col("_w1").cast("double"), q1).alias("whisker_low"),
        F.greatest(F.col("_w2").cast("double"), q3).alias("whisker_high"),
        "n_outliers",
    )


def outliers(counts: DataFrame) -> DataFrame:
    """Lengths beyond the whiskers with their counts."""
    box = _quartiles(counts)
    low, high = box.select("_low").scalar(), box.select("_high").scalar()
    return counts.where((F.col("length") < low) | (F.col("length") > high)).select("length", "n")


def class_distribution(df: DataFrame, target: str = "label") -> DataFrame:
    """Rows and share per class, in class order."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    # One row per class reaches this window.
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", share).orderBy(target)


def class_range(df: DataFrame, target: str = "label") -> DataFrame:
    """Number of classes, smallest and largest class, total rows."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.sum("n").alias("total"),
    )
