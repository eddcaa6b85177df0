"""Curate a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.operators import corpus
from sectorscope.operators.sizing import settle


def prepare_corpus(
    repos: DataFrame,
    target: str = "code",
    clean: bool = True,
    max_readme_words: int | None = None,
    min_samples: int | None = None,
    labels: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """``(prepared, label_dim)``: training text and label id per usable row.

    One narrow job counts the classes; from those few rows come both the class filter and
    the label ids, so a single broadcast join filters and labels.  The texts are formatted
    in the same pass and never shuffled.  ``labels`` fixes the ids, as for a stored model;
    ``keep`` names columns, such as the row id, to carry along.
    """
    rows = corpus.drop_null_target(repos, target)
    narrow = rows.select(target)
    if labels is None or min_samples:
        counts, _ = settle(corpus.class_counts(narrow, target))
        valid = counts.where(F.col("n") >= (min_samples or 0))
        known = corpus.label_dim(valid, target)
        labels = known if labels is None else labels.join(known.select("code"), "code", "left_semi")
    labelled = corpus.attach_label(corpus.normalize_topics(rows), labels, target)
    text = corpus.training_text_column(labelled, clean, max_readme_words)
    return labelled.withColumn("text", text).select(*keep, "text", "label"), labels
