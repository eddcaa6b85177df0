"""A text classifier that is a table: a weight for every word and class.

The weights follow from counts in one pass: the log of a word's smoothed share of its class's words,
times the word's inverse document frequency.  Scoring is a sparse join of a row's words with the
table, and a sum for each row.  Offsets for the classes are then fitted by gradient descent, where
objective and gradient of each step are one aggregation over the rows.

Nothing here holds a vocabulary on the driver.  Words are counted where their row lies, so one row per
word and label leaves a task.  For scoring, the words of most rows are broadcast, as many as were
counted to be few enough, and only a row's other words move to their weights; words that are frequent
in the scored rows alone are salted.  Each task sums what it has of a row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.functions import scores as sc
from sectorscope.functions.text import tokens
from sectorscope.operators.sizing import MAX_BROADCAST_ROWS, hot_key_join, local_table, settle
from sectorscope.sources.paths import store

CURVE = "step int, metric string, value double"
# Words are parted by frequency in steps of this share of a power of e.
IDF_STEPS = 16
# A broadcast of so many classes' weights for each word is what the bound on its rows is meant for.
BROADCAST_CLASSES = 16


def _words(rows: DataFrame, text: str, max_tokens: int | None, keep: Sequence[str]) -> DataFrame:
    found = F.explode(tokens(F.coalesce(F.col(text), F.lit("")), max_tokens))
    return rows.select(*keep, found.alias("word"))


def _counted_words(known: DataFrame, text: str, label: str, id_col: str, max_tokens: int | None) -> DataFrame:
    """``word``, ``label``, ``c`` (how often), ``d`` (1 once for every ``id_col``, label and word; else 0).

    A row's words are sorted in place, so a word's first place in its row is known without a shuffle.
    Rows that share their id and label count as one: they are looked for, and gathered by word.
    """
    repeated = known.groupBy(id_col, label).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(id_col, label)
    repeated, few = settle(repeated)
    once, several = known, None
    if not few:
        once, several = None, known
    elif not repeated.isEmpty():
        same = known[id_col].eqNullSafe(repeated[id_col]) & (known[label] == repeated[label])
        once = known.join(F.broadcast(repeated), same, "left_anti")
        several = known.join(F.broadcast(repeated), same, "left_semi")
    parts = []
    if once is not None:
        ordered = once.select(label, F.sort_array(tokens(F.coalesce(F.col(text), F.lit("")), max_tokens)).alias("_words"))
        before = F.concat(F.array(F.lit(None).cast("string")), F.col("_words")).alias("before")
        placed = ordered.select(label, F.explode(F.arrays_zip(F.col("_words").alias("word"), before)).alias("_w"))
        placed = placed.where(F.col("_w.word").isNotNull())
        first = (~F.col("_w.word").eqNullSafe(F.col("_w.before"))).cast("long")
        parts.append(placed.select(F.col("_w.word").alias("word"), label, F.lit(1).cast("long").alias("c"), first.alias("d")))
    if several is not None:
        by_row = _words(several, text, max_tokens, [id_col, label]).groupBy(id_col, label, "word")
        parts.append(by_row.agg(F.count("*").alias("c")).select("word", label, "c", F.lit(1).cast("long").alias("d")))
    return reduce(DataFrame.unionByName, parts)


def fit_weights(
    train: DataFrame,
    n_classes: int,
    text: str = "text",
    label: str = "label",
    id_col: str = "id",
    max_tokens: int | None = None,
) -> DataFrame:
    """``word``, ``idf`` and ``weights``, one for each label 0, 1, ...: the model.

    A label's words are counted with one more of each; the inverse document frequency is
    ``ln((rows + 1) / (rows with the word + 1))``.  Runs jobs: the counts are stored, and read for
    the totals and each time that the model is used.
    """
    labels = [F.lit(k) for k in range(n_classes)]
    known = train.where(F.col(label).between(0, n_classes - 1))
    counted = _counted_words(known, text, label, id_col, max_tokens)
    by_label = counted.groupBy("word", label).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    words = by_label.groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == k, F.col("c"))), F.lit(0)).alias(f"_c{i}") for i, k in enumerate(labels)],
        F.sum("d").alias("_rows_with"),
    )
    words = store(words, "word-counts")
    totals = words.agg(F.count("*").alias("v"), *[F.sum(f"_c{i}").alias(f"t{i}") for i in range(n_classes)]).first()
    n_rows = known.count()
    idf = F.log(F.lit(float(n_rows + 1)) / (F.col("_rows_with") + 1))
    share = [
        F.log((F.col(f"_c{i}") + 1) / F.lit(float((totals[f"t{i}"] or 0) + totals["v"]))) for i in range(n_classes)
    ]
    return words.select("word", idf.alias("idf"), F.array(*[idf * s for s in share]).alias("weights"))


def _frequent(weights: DataFrame, max_rows: int) -> tuple[Column | None, bool]:
    """Condition for the most frequent words, ``max_rows`` at most, and whether these are all words.

    Runs a job that counts the words by steps of their inverse document frequency.
    """
    step = F.floor(F.col("idf") * IDF_STEPS)
    counts = weights.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()
    total, last = 0, None
    for row in counts:
        if total + row["n"] > max_rows:
            return (None if last is None else step <= last), False
        total, last = total + row["n"], row["step"]
    return F.lit(True), True


def score_words(
    rows: DataFrame,
    weights: DataFrame,
    n_classes: int,
    text: str = "text",
    id_col: str = "id",
    max_tokens: int | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``id_col`` and ``logits``: the mean weight of the row's known words for every class.

    A row without a known word has zeros.  ``id_col`` must identify rows.  The most frequent words,
    up to ``max_rows`` (fewer where there are many classes), are broadcast; all others of a row are stored
    and joined by shuffle.  Runs jobs.
    """
    words = _words(rows, text, max_tokens, [id_col])
    frequent, is_all = _frequent(weights, max_rows * BROADCAST_CLASSES // max(BROADCAST_CLASSES, n_classes))
    table, parts = weights.select("word", "weights"), []
    if frequent is not None:
        parts.append(words.join(F.broadcast(weights.where(frequent).select("word", "weights")), "word"))
        words = words.join(F.broadcast(weights.where(frequent).select("word")), "word", "left_anti")
        table = weights.where(~frequent).select("word", "weights")
    if not is_all:
        parts.append(hot_key_join(store(words, "other-words"), table, "word"))
    found = reduce(DataFrame.unionByName, parts)
    sums = found.groupBy(id_col).agg(
        F.count("*").alias("_n"), *[F.sum(F.get("weights", F.lit(k))).alias(f"_s{k}") for k in range(n_classes)]
    )
    means = sums.select(id_col, F.array(*[F.col(f"_s{k}") / F.col("_n") for k in range(n_classes)]).alias("logits"))
    nothing = F.array(*[F.lit(0.0)] * n_classes)
    return rows.select(id_col).join(means, id_col, "left").select(id_col, F.coalesce("logits", nothing).alias("logits"))


def _shifted(logits: Column, offsets: Sequence[float]) -> Column:
    return F.array(*[F.get(logits, F.lit(k)) + F.lit(float(b)) for k, b in enumerate(offsets)])


def with_offsets(scored: DataFrame, offsets: Sequence[float], logits: str = "logits") -> DataFrame:
    """Add ``probabilities`` of the classes."""
    return scored.withColumn("probabilities", sc.softmax(_shifted(F.col(logits), offsets)))


def objective(
    scored: DataFrame, offsets: Sequence[float], penalty: float, label: str = "label", logits: str = "logits"
) -> tuple[float, list[float]]:
    """Mean log loss plus half the penalty on the squared offsets, and its gradient; one job.

    Equal for any partitioning but for the last digits of a sum.
    """
    p = F.col("probabilities")
    hit = [(F.col(label) == k).cast("double") for k in range(len(offsets))]
    row = (
        with_offsets(scored, offsets, logits)
        .agg(
            F.avg(-F.log(F.get(p, F.col(label).cast("int")))).alias("loss"),
            *[F.avg(F.get(p, F.lit(k)) - hit[k]).alias(f"g{k}") for k in range(len(offsets))],
        )
        .first()
    )
    if row["loss"] is None:
        raise ValueError("No rows to fit on")
    return (
        row["loss"] + penalty / 2 * sum(b * b for b in offsets),
        [row[f"g{k}"] + penalty * b for k, b in enumerate(offsets)],
    )


def fit_offsets(
    scored: DataFrame,
    n_classes: int,
    steps: int = 4,
    rate: float = 2.0,
    penalty: float = 0.01,
    label: str = "label",
    logits: str = "logits",
) -> tuple[list[float], DataFrame]:
    """Class offsets by gradient descent from zero, and the curve ``(step, metric, value)``.

    ``scored`` should be stored: each of ``steps + 1`` jobs reads it.
    """
    offsets, curve = [0.0] * n_classes, []
    for step in range(steps + 1):
        value, gradient = objective(scored, offsets, penalty, label, logits)
        curve.append((step, "loss", value))
        if step < steps:
            offsets = [b - rate * g for b, g in zip(offsets, gradient)]
    return offsets, local_table(scored.sparkSession, curve, CURVE)
