"""Evaluate a classifier on the held-out part of a labelled table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.functions.scores import argmax
from sectorscope.operators import evaluation as ev
from sectorscope.operators.corpus import attach_code
from sectorscope.operators.sizing import settle
from sectorscope.operators.split import stratified_split
from sectorscope.plans.prepare import prepare_corpus
from sectorscope.plans.score import AddScores

SPLITS = ("train", "validation", "test")


def predicted_pairs(rows: DataFrame, add_scores: AddScores, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, prediction) of every row."""
    scored = add_scores(rows).withColumn("_guess", argmax(F.col("probabilities")))
    return ev.truth_prediction(scored, "label", "_guess", by)


def evaluate_split(rows: DataFrame, add_scores: AddScores, split: str = "test") -> DataFrame:
    """Metric row of one named split."""
    if split not in SPLITS:
        raise ValueError(f"Split '{split}' not found in dataset")
    pairs = predicted_pairs(rows.where(F.col("split") == split), add_scores)
    return ev.metrics(ev.confusion_counts(pairs))


@dataclass
class Evaluation:
    """Tables of one evaluation, each derived on demand from the same confusion cells."""

    cells: DataFrame
    labels: DataFrame

    @property
    def metrics(self) -> DataFrame:
        return ev.average_metrics(self.cells, ("weighted",))

    @property
    def report(self) -> DataFrame:
        return ev.classification_report(self.cells, labels=self.labels)

    @property
    def ranking(self) -> DataFrame:
        return ev.class_ranking(self.report)

    @property
    def matrix(self) -> DataFrame:
        """Row-normalized matrix with class names on both sides."""
        named = attach_code(ev.heatmap(self.cells), self.labels, "label", "label_code")
        return attach_code(named, self.labels, "prediction", "prediction_code")

    @property
    def test_size(self) -> DataFrame:
        return self.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_test"))


def evaluate_counts(counts: DataFrame, labels: DataFrame) -> Evaluation:
    """Fetch the confusion cells once, one row per cell; every table is a sum over them."""
    cells, _ = settle(counts)
    return Evaluation(cells, labels)


def evaluate_table(
    repos: DataFrame,
    add_scores: AddScores,
    labels: DataFrame | None = None,
    target: str = "code",
    id_col: str = "id",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> Evaluation:
    """Prepare with the model's own label ids, split as in training, score the test part.

    Without a stored label map the ids are those of the data's own classes, in order of code.
    """
    prepared, labels = prepare_corpus(repos, target, labels=labels, keep=[id_col])
    rows = stratified_split(prepared, "label", id_col, test_size, val_size, seed)
    pairs = predicted_pairs(rows.where(F.col("split") == "test"), add_scores)
    return evaluate_counts(ev.confusion_counts(pairs), labels)
