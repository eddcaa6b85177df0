"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.sources.paths import store


def components(links: DataFrame) -> DataFrame:
    """(``v``, ``label``) for every vertex in ``links`` (``a``, ``b``); the label is the least vertex.

    Each round takes the least label among a vertex and its neighbours, then the label of that
    label, so chains shrink by more than half; it ends when a round changes nothing.  Rounds
    are stored, which cuts the lineage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store(both, "links")
    # The least neighbour is a good first label.
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = store(labels, "labels")
    while True:
        reached = (
            both.join(labels.select(F.col("v").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(reached, "v").select(
            "v", "label", F.least("label", "near").alias("low")
        )
        onward = lower.select(F.col("v").alias("low"), F.col("low").alias("onward"))
        step = lower.join(onward, "low").select("v", F.least("low", "onward").alias("new"), "label")
        step = store(step, "labels")
        changed = step.where(F.col("new") != F.col("label")).limit(1).count()
        labels = step.select("v", F.col("new").alias("label"))
        if not changed:
            return labels
