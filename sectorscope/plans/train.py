"""Train a classifier end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.operators import classify as cl
from sectorscope.operators import evaluation as ev
from sectorscope.operators import table_model as tm
from sectorscope.operators.sizing import settle
from sectorscope.operators.split import stratified_split
from sectorscope.plans.evaluate import predicted_pairs
from sectorscope.plans.prepare import prepare_corpus
from sectorscope.sources.paths import shared_folder, store
from sectorscope.sources.writers import save_model

# A multinomial model holds a row of coefficients for each class on the driver.
MAX_CLASSES = 10_000


@dataclass
class Training:
    model: PipelineModel
    labels: DataFrame
    metrics: DataFrame  # one row per held-out split
    sizes: DataFrame  # rows of every split
    gap: DataFrame
    curve: DataFrame
    corpus: DataFrame  # stored: id, text as trained on, label and split


def train_classifier(
    repos: DataFrame,
    target: str = "code",
    id_col: str = "id",
    min_samples: int | None = 80,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    reg_params: Sequence[float] = (0.001, 0.01),
    max_iter: int = 20,
    max_tokens: int | None = None,
    n_features: int = 1 << 16,
    save_to: str | None = None,
) -> Training:
    """Prepare, split, fit, compare validation with test, save.

    The split corpus is written once to the shared folder, partitioned by split: the fit
    reads it several times, and a lost executor must not mean cleaning all texts again.
    """
    prepared, labels = prepare_corpus(repos, target, min_samples=min_samples, keep=[id_col])
    labels, _ = settle(labels)
    spark = repos.sparkSession
    folder = shared_folder(spark, "corpus")
    split = stratified_split(prepared, "label", id_col, test_size, val_size, seed)
    split.write.mode("overwrite").partitionBy("split").parquet(folder)
    corpus = spark.read.parquet(folder)

    def part(name: str) -> DataFrame:
        return corpus.where(F.col("split") == name)

    codes = [r["code"] for r in labels.orderBy("label").limit(MAX_CLASSES + 1).collect()]
    if len(codes) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes")
    model, curve = cl.fit_best(
        part("train"),
        part("validation"),
        codes,
        reg_params=reg_params,
        max_iter=max_iter,
        max_tokens=max_tokens,
        n_features=n_features,
    )
    held_out = corpus.where(F.col("split").isin("validation", "test"))
    pairs = predicted_pairs(held_out, lambda df: cl.score_with_model(df, model), by=("split",))
    counts, _ = settle(ev.confusion_counts(pairs, ["split"]))
    by_split = ev.metrics(counts, ["split"])
    if save_to:
        save_model(model, labels, save_to)
    sizes = corpus.groupBy("split").agg(F.count("*").alias("n_rows"))
    return Training(model, labels, by_split, sizes, ev.generalization_gap(by_split), curve, corpus)


@dataclass
class WordModel:
    weights: DataFrame  # word, idf, weights: one for each label
    offsets: list[float]  # one for each label
    labels: DataFrame
    curve: DataFrame

    def score(self, rows: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
        """``id_col`` and ``probabilities`` of the rows."""
        logits = tm.score_words(rows, self.weights, len(self.offsets), text, id_col)
        return tm.with_offsets(logits, self.offsets).drop("logits")


def train_words(
    prepared: DataFrame,
    labels: DataFrame,
    id_col: str = "id",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    steps: int = 4,
    rate: float = 2.0,
    penalty: float = 0.01,
) -> WordModel:
    """Split, count the words of the training part, fit the offsets on the validation part.

    ``prepared`` has ``text`` and ``label`` (numbers from 0, as in ``labels``).  The split corpus, the
    counts behind the weights and the validation scores are stored.
    """
    n_classes = labels.count()
    if n_classes > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes")
    corpus = store(stratified_split(prepared, "label", id_col, test_size, val_size, seed), "corpus")
    train, validation = (corpus.where(F.col("split") == part) for part in ("train", "validation"))
    weights = tm.fit_weights(train, n_classes, id_col=id_col)
    logits = tm.score_words(validation, weights, n_classes, id_col=id_col)
    scored = store(logits.join(validation.select(id_col, "label"), id_col), "validation-logits")
    offsets, curve = tm.fit_offsets(scored, n_classes, steps, rate, penalty)
    return WordModel(weights, offsets, labels, curve)
