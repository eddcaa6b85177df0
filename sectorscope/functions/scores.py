"""Expressions over one row's class scores (an array with one entry per class index)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Class probabilities; the maximum is subtracted first so that exp cannot overflow."""

    def exps(values: Column) -> Column:
        return let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))

    return normalize(let(logits.cast("array<double>"), exps))


def normalize(weights: Column) -> Column:
    """Scale an array of weights to sum 1."""

    def divide(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(values, lambda x: x / t))

    return let(weights, divide)


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """Best ``k`` classes as array<struct<score, class_index>>, lower index first on ties."""
    tagged = F.transform(scores, lambda s, i: F.struct(s.alias("score"), (-i).alias("rev")))
    best = F.slice(F.sort_array(tagged, asc=False), 1, k)
    return F.transform(
        best, lambda e: F.struct(e["score"].alias("score"), (-e["rev"]).cast("int").alias("class_index"))
    )


def score_map(labels: Column, scores: Column) -> Column:
    """label -> score for all classes."""
    return F.map_from_arrays(labels, scores)
