"""Evaluation from confusion counts.

Rows are reduced once to (truth, prediction, n); every metric is a sum over that table, so
the large input is read and shuffled (pre-aggregated) exactly once.  ``by`` columns, such as
the split, are carried along to evaluate several groups in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.operators.corpus import attach_code

SUMMARY_ROWS = ("accuracy", "macro avg", "weighted avg")


def truth_prediction(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of label and prediction of a scored table."""
    return df.select(*by, F.col(truth).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))


def confusion_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty confusion cells."""
    return pairs.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))


def _roles(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class: true positives, support (rows of the class) and predicted rows.

    Each cell counts once for its truth and once for its prediction, so a class seen on one
    side only is kept.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    as_truth = F.struct(
        F.col("label").alias("class_id"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")
    )
    as_guess = F.struct(
        F.col("prediction").alias("class_id"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("support"),
        F.col("n").alias("predicted"),
    )
    seen = counts.select(*by, F.explode(F.array(as_truth, as_guess)).alias("r")).select(*by, "r.*")
    return seen.groupBy(*by, "class_id").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return _roles(counts, by).select(
        *by,
        "class_id",
        "tp",
        "predicted",
        "support",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def average_metrics(counts: DataFrame, averages: Sequence[str] = ("weighted",), by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 for the chosen averages, one row each."""
    unknown = set(averages) - {"weighted", "macro", "micro"}
    if unknown:
        raise ValueError(f"Unsupported average: {sorted(unknown)}")
    weight = {"weighted": F.col("support").cast("double"), "macro": F.lit(1.0)}
    accuracy = _ratio(F.sum("tp"), F.sum("support"))
    sums = [accuracy.alias("accuracy")]
    for name, w in weight.items():
        for m in ("precision", "recall", "f1"):
            sums.append(_ratio(F.sum(F.col(m) * w), F.sum(w)).alias(f"{name}_{m}"))
    wide = class_metrics(counts, by).groupBy(*by).agg(*sums)

    def pick(name: str) -> Column:
        # Over all classes the micro average of each metric equals accuracy.
        cols = ["accuracy"] * 3 if name == "micro" else [f"{name}_{m}" for m in ("precision", "recall", "f1")]
        return F.struct(
            F.lit(name).alias("average"),
            F.col("accuracy").alias("accuracy"),
            *[F.col(c).alias(m) for c, m in zip(cols, ("precision", "recall", "f1"))],
        )

    return wide.select(*by, F.explode(F.array(*map(pick, averages))).alias("m")).select(*by, "m.*")


def metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted F1, accuracy, precision and recall."""
    return average_metrics(counts, ("weighted",), by).select(*by, "f1", "accuracy", "precision", "recall")


def classification_report(counts: DataFrame, by: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """One row per class plus accuracy, macro average and weighted average.

    ``labels`` (label, code) names the classes; ids are matched as numbers.  The summary rows
    come out of the same aggregation: each class row also contributes to them.
    """
    per_class = class_metrics(counts, by).withColumn("class", F.col("class_id").cast("string"))
    if labels is not None:
        per_class = attach_code(per_class.drop("class"), labels, "class_id", "class")

    names = ("precision", "recall", "f1")

    def row(seq: Column, name: Column, weight: Column, values: list[Column]) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"),
            name.alias("class"),
            weight.cast("double").alias("w"),
            F.col("support").alias("support"),
            *[v.cast("double").alias(m) for m, v in zip(names, values)],
        )

    nothing = F.lit(None)
    own = [F.col(m) for m in names]
    share = _ratio(F.col("tp"), F.col("support"))
    rows = F.array(
        row(F.col("class_id"), F.col("class"), F.lit(1.0), own),
        row(F.lit(1 << 30), F.lit(SUMMARY_ROWS[0]), F.col("support"), [nothing, nothing, share]),
        row(F.lit((1 << 30) + 1), F.lit(SUMMARY_ROWS[1]), F.lit(1.0), own),
        row(F.lit((1 << 30) + 2), F.lit(SUMMARY_ROWS[2]), F.col("support"), own),
    )

    def mean(m: str) -> Column:
        known = F.col(m).isNotNull()
        value = _ratio(F.sum(F.col(m) * F.col("w")), F.sum("w"))
        return F.when(F.count(F.when(known, 1)) > 0, value).alias(m)

    return (
        per_class.select(*by, F.explode(rows).alias("r"))
        .select(*by, "r.*")
        .groupBy(*by, "seq", "class")
        .agg(*[mean(m) for m in names], F.sum("support").alias("support"))
    )


def class_ranking(report: DataFrame, metric: str = "f1") -> DataFrame:
    """Classes by metric, then name, both descending; summary rows are left out."""
    return (
        report.where(~F.col("class").isin(*SUMMARY_ROWS))
        .select("class", metric)
        .orderBy(F.desc(metric), F.desc("class"))
    )


def confusion_matrix(counts: DataFrame, normalize: str | None = None, zero_rows: str = "zero") -> DataFrame:
    """All cells over the classes seen as truth or prediction, long form.

    ``normalize``: ``true``, ``pred``, ``all`` or None.  ``zero_rows='null'`` leaves the cells
    of a class without denominator undefined instead of 0.  Everything here has at most one
    row per class or cell.
    """
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError(f"Unsupported normalization: {normalize}")
    everyone = Window.partitionBy()
    # Per class: its row of the matrix as a map, then empty cells filled from the class list.
    as_truth = F.struct(F.col("label").alias("label"), F.struct("prediction", "n").alias("cell"))
    as_guess = F.struct(F.col("prediction").alias("label"), F.lit(None).alias("cell"))
    rows = (
        counts.select(F.explode(F.array(as_truth, as_guess)).alias("r"))
        .select("r.*")
        .groupBy("label")
        .agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
        .withColumn("classes", F.sort_array(F.collect_list("label").over(everyone)))
    )
    cells = rows.select("label", F.explode("classes").alias("prediction"), "cells").select(
        "label", "prediction", F.coalesce(F.try_element_at("cells", F.col("prediction")), F.lit(0)).cast("long").alias("n")
    )
    if normalize is None:
        return cells
    scope = {"true": Window.partitionBy("label"), "pred": Window.partitionBy("prediction"), "all": everyone}[normalize]
    part = F.try_divide(F.col("n").cast("double"), F.sum("n").over(scope).cast("double"))
    return cells.withColumn("value", part if zero_rows == "null" else F.coalesce(part, F.lit(0.0)))


def heatmap(counts: DataFrame) -> DataFrame:
    """Row-normalized matrix; cells of a class without true rows are undefined."""
    return confusion_matrix(counts, "true", zero_rows="null")


def _verdict(gaps: DataFrame, threshold: float) -> DataFrame:
    """Accuracy is looked at last: it overrides F1 only when it crosses a limit itself."""

    def crossing(m: str) -> Column:
        gap = F.col(f"{m}_gap")
        return F.when(gap > threshold, "potential_overfitting").when(gap < -threshold, "unusual")

    return gaps.withColumn("status", F.coalesce(crossing("accuracy"), crossing("f1"), F.lit("good")))


def generalization_gap(split_metrics: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Validation minus test for F1 and accuracy, and the verdict on the model.

    ``split_metrics`` has one row per split, as ``metrics(counts, by=["split"])`` gives.
    """

    def value(split: str, m: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(m)))

    gaps = split_metrics.agg(
        *[(value("validation", m) - value("test", m)).alias(f"{m}_gap") for m in ("f1", "accuracy")]
    )
    return _verdict(gaps, threshold)
