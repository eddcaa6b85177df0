"""Corpus curation: target cleaning, class filter, label ids, training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.functions import text as tx
from sectorscope.operators.sizing import lookup_join


def column_or_null(df: DataFrame, *names: str) -> Column:
    """First non-null of the named columns that exist; null where none does."""
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def is_array(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)


def drop_null_target(df: DataFrame, target: str = "code") -> DataFrame:
    """Keep rows with a target (neither null nor NaN); the target becomes text."""
    return df.na.drop(subset=[target]).withColumn(target, F.col(target).cast("string"))


def class_counts(df: DataFrame, target: str = "code") -> DataFrame:
    return df.groupBy(target).agg(F.count("*").alias("n"))


def excluded_classes(df: DataFrame, target: str, min_samples: int) -> DataFrame:
    """Classes below the minimum, with their counts."""
    return class_counts(df, target).where(F.col("n") < min_samples)


def keep_frequent_classes(df: DataFrame, target: str, min_samples: int | None) -> DataFrame:
    """Rows of classes with at least ``min_samples`` rows.

    Only the target column is read for counting, and the surviving classes are broadcast
    when they are few, so the texts are never shuffled.
    """
    if not min_samples or min_samples <= 0:
        return df
    valid = class_counts(df, target).where(F.col("n") >= min_samples).select(target)
    return lookup_join(df, valid, target, "left_semi")


def filter_report(df: DataFrame, target: str, min_samples: int) -> DataFrame:
    """Rows and classes before and after the null and class filters, from one count per class."""
    counts = class_counts(df.select(F.col(target).cast("string").alias(target)), target)
    known = F.col(target).isNotNull()
    kept = known & (F.col("n") >= min_samples)

    def stage(seq: int, name: str, keep: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"),
            F.lit(name).alias("stage"),
            F.when(keep, F.col("n")).otherwise(0).alias("n"),
            (keep & known).cast("long").alias("k"),
        )

    stages = F.array(stage(0, "original", F.lit(True)), stage(1, "target_present", known), stage(2, "class_filter", kept))
    return (
        counts.select(F.explode(stages).alias("s"))
        .groupBy(F.col("s.seq").alias("seq"), F.col("s.stage").alias("stage"))
        .agg(F.sum("s.n").alias("n_rows"), F.sum("s.k").alias("n_classes"))
    )


def label_dim(df: DataFrame, target: str = "code") -> DataFrame:
    """``(label, code)``: distinct codes in string order, numbered from 0.

    The rows are reduced to distinct codes first; only those are numbered in one place.
    """
    codes = df.select(F.col(target).alias("code")).where(F.col("code").isNotNull()).distinct()
    position = F.row_number().over(Window.orderBy("code")) - 1
    return codes.select(position.cast("int").alias("label"), "code")


def attach_label(df: DataFrame, labels: DataFrame, target: str = "code", out: str = "label") -> DataFrame:
    """Code -> label id; rows whose code has no label are left out."""
    side = labels.select(F.col("code").alias(target), F.col("label").alias(out))
    return lookup_join(df, side, target, "inner")


def attach_code(df: DataFrame, labels: DataFrame, label: str = "class_index", out: str = "predicted_naics") -> DataFrame:
    """Label id (number or text) -> code; an id without a code is shown as text."""
    side = labels.select(F.col("label").cast("int").alias("_id"), F.col("code").alias("_code"))
    joined = lookup_join(df.withColumn("_id", F.col(label).try_cast("int")), side, "_id", "left")
    return joined.withColumn(out, F.coalesce("_code", F.col(label).cast("string"))).drop("_id", "_code")


def normalize_topics(df: DataFrame) -> DataFrame:
    """Topics of any stored shape to ``a; b``, where the column exists."""
    if "topics" not in df.columns:
        return df
    return df.withColumn("topics", tx.clean_topics(F.col("topics"), is_array(df, "topics")))


def training_text_column(df: DataFrame, clean: bool = True, max_readme_words: int | None = None) -> Column:
    """Training text from whichever of the known columns the table has."""
    return tx.training_text(
        column_or_null(df, "name_repo", "repo"),
        column_or_null(df, "description"),
        column_or_null(df, "topics"),
        column_or_null(df, "readme_content"),
        clean,
        max_readme_words,
    )


def simple_text_column(df: DataFrame) -> Column:
    """Simple text; an empty name falls through to the other name column."""
    names = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in ("name_repo", "repo", "repo_name") if n in df.columns]
    return tx.simple_text(
        F.coalesce(*names) if names else F.lit(None).cast("string"),
        column_or_null(df, "description"),
        column_or_null(df, "topics"),
        column_or_null(df, "readme_content", "readme"),
    )


def batch_text_column(df: DataFrame, max_readme_chars: int | None = 5000, clean: bool = True) -> Column:
    """Scoring text; ``name`` and ``readme`` win over ``name_repo`` and ``readme_content``."""
    name = "name" if "name" in df.columns else "name_repo"
    readme = "readme" if "readme" in df.columns else "readme_content"
    listed = is_array(df, "topics")
    return tx.batch_text(
        column_or_null(df, name),
        column_or_null(df, "description"),
        F.col("topics").cast("array<string>") if listed else column_or_null(df, "topics"),
        column_or_null(df, readme),
        max_readme_chars,
        clean,
        topics_is_array=listed,
    )


def take_rows(df: DataFrame, limit: int | None, order_by: str | None = None) -> DataFrame:
    """First ``limit`` rows, all of them for 0 or None; ``order_by`` makes the choice repeatable."""
    if not limit:
        return df
    return (df.orderBy(order_by) if order_by else df).limit(limit)
