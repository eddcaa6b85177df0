"""Text classification: fit, score, and turn class scores into codes.

Scoring functions add ``probabilities`` (array, one entry per class index); everything after
that is shared, whichever model produced the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, IndexToString, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sectorscope.functions import scores as sc
from sectorscope.functions.text import tokens
from sectorscope.operators import evaluation as ev
from sectorscope.operators.corpus import attach_code
from sectorscope.operators.sizing import local_table
from sectorscope.sources.paths import store

# A scorer opens a model and returns texts -> logits (rows x classes).
Scorer = Callable[[Sequence[str]], np.ndarray]
_WORK = ("_tokens", "_counts", "_features", "_prediction", "_raw", "_probability", "_code")


def tokenize(df: DataFrame, max_tokens: int | None = None, text: str = "text", label: str = "label") -> DataFrame:
    """Replace the text by its tokens, all unless ``max_tokens`` is given, and rename the label."""
    out = df.withColumn("tokens", tokens(F.col(text), max_tokens)).drop(text)
    return out.withColumnRenamed(label, "labels") if label in df.columns else out


def _counter(text: str, max_tokens: int | None, n_features: int) -> PipelineModel:
    """Text to ``_counts`` of hashed words; nothing in it is fitted."""
    limit = -1 if max_tokens is None else max_tokens + 2
    words = f"filter(split(lower(coalesce({text}, '')), '\\\\s+', {limit}), w -> w <> '')"
    if max_tokens is not None:
        words = f"slice({words}, 1, {max_tokens})"
    return PipelineModel(
        stages=[
            SQLTransformer(statement=f"SELECT *, {words} AS _tokens FROM __THIS__"),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=n_features),
        ]
    )


def _classifier(label: str, reg_param: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        predictionCol="_prediction",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        family="multinomial",
        regParam=reg_param,
        maxIter=max_iter,
    )


def fit_best(
    train: DataFrame,
    validation: DataFrame,
    codes: Sequence[str],
    text: str = "text",
    label: str = "label",
    reg_params: Sequence[float] = (0.001, 0.01),
    max_iter: int = 20,
    max_tokens: int | None = None,
    n_features: int = 1 << 16,
    side_by_side: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """Fit one model per regularization, keep the best by weighted F1 on ``validation``.

    Words are counted once per split, in whole texts unless ``max_tokens`` is given, and the counts
    stored in the shared folder: every fit, also that of the document frequencies, reads these, and a
    lost executor tokenizes nothing again.  Up to ``side_by_side`` candidates are fitted at a time; of
    equally good ones the first stays.
    Returns the model and its training curve.
    """
    counter = _counter(text, max_tokens, n_features)
    counts = store(counter.transform(train).select(label, "_counts"), "train-counts")
    idf = IDF(inputCol="_counts", outputCol="_features").fit(counts)
    train_x = idf.transform(counts).select(label, "_features")

    def fit(reg: float) -> LogisticRegressionModel:
        return _classifier(label, reg, max_iter).fit(train_x)

    if len(reg_params) == 1:
        best = fit(reg_params[0])
    else:
        val_x = store(counter.transform(validation).select(label, "_counts"), "validation-counts")
        val_x = idf.transform(val_x).select(label, "_features")

        def candidate(reg: float) -> tuple[float, LogisticRegressionModel]:
            fitted = fit(reg)
            pairs = ev.truth_prediction(fitted.transform(val_x), label, "_prediction")
            return ev.metrics(ev.confusion_counts(pairs)).first()["f1"], fitted

        run = inheritable_thread_target(train.sparkSession)(candidate)
        with ThreadPoolExecutor(side_by_side) as pool:
            best = max(pool.map(run, reg_params), key=lambda found: found[0])[1]
    curve = training_curve(train, best)
    names = IndexToString(inputCol="_prediction", outputCol="_code", labels=list(codes))
    return PipelineModel(stages=[*counter.stages, idf, best, names]), curve


def training_curve(df: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Objective per iteration as ``(step, metric, value)``; one row per iteration."""
    history = enumerate(model.summary.objectiveHistory)
    rows = [(step, "loss", float(value)) for step, value in history]
    return local_table(df.sparkSession, rows, "step int, metric string, value double")


def model_codes(model: PipelineModel) -> list[str]:
    """The label map the model itself carries."""
    return list(model.stages[-1].getLabels())


def score_with_model(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Add ``probabilities`` from a fitted model; the text column must be named as in training."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array("_probability"))
    return scored.drop(*_WORK)


def text_batches(lengths: np.ndarray, batch_size: int, max_chars: int) -> Iterator[np.ndarray]:
    """Places of texts of similar length: at most ``batch_size`` and ``max_chars`` at a time, counted as
    the longest one's length for each (scorers pad); a longer text is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while (
            end < len(order)
            and end - start < batch_size
            and (end - start + 1) * int(lengths[order[end]]) <= max_chars
        ):
            end += 1
        yield order[start:end]
        start = end


def score_with(
    df: DataFrame,
    open_scorer: Callable[[], Scorer],
    text: str = "text",
    batch_size: int = 256,
    max_chars: int = 4_000_000,
) -> DataFrame:
    """Add ``probabilities`` from an external scorer.

    Only the text column travels to Python, in Arrow batches whose bytes
    ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds.  The scorer is opened once per task and called
    on texts of similar length: at most ``batch_size`` of them, and ``max_chars`` characters.
    """

    def probabilities(logits: np.ndarray) -> np.ndarray:
        weights = np.exp(logits - logits.max())
        return weights / weights.sum()

    @pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = open_scorer()
        for batch in batches:
            out = np.empty(len(batch), dtype="object")
            for places in text_batches(batch.str.len().to_numpy(dtype="int64"), batch_size, max_chars):
                found = score(batch.iloc[places].tolist())
                for place, row in zip(places, found, strict=True):
                    out[place] = probabilities(np.asarray(row, dtype="float64"))
            yield pd.Series(out, dtype="object")

    return df.withColumn("probabilities", scored(F.coalesce(F.col(text), F.lit(""))))


def score_logits(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``probabilities`` from a column of logits."""
    return df.withColumn("probabilities", sc.softmax(F.col(logits)))


def classify(df: DataFrame, labels: DataFrame, keep_scores: bool = False) -> DataFrame:
    """Best class per row: ``class_index``, ``confidence``, ``predicted_naics``."""
    best = df.withColumn("class_index", sc.argmax(F.col("probabilities"))).withColumn(
        "confidence", F.array_max("probabilities")
    )
    named = attach_code(best, labels, "class_index", "predicted_naics")
    return named if keep_scores else named.drop("probabilities")


def top_classes(df: DataFrame, labels: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """Best ``k`` classes of every row as ranked rows."""
    ranked = df.select(*keep, F.posexplode(sc.top_k(F.col("probabilities"), k)).alias("_pos", "_e")).select(
        *keep, (F.col("_pos") + 1).alias("rank"), F.col("_e.class_index").alias("class_index"), F.col("_e.score").alias("score")
    )
    return attach_code(ranked, labels, "class_index", "predicted_naics")


def all_scores(df: DataFrame, codes: Sequence[str], out: str = "all_scores") -> DataFrame:
    """Map code -> probability for every class."""
    names = F.array(*[F.lit(c) for c in codes])
    return df.withColumn(out, sc.score_map(names, F.col("probabilities")))
