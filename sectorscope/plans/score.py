"""Score a repository table and summarize the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.functions.text import percent
from sectorscope.operators import classify as cl
from sectorscope.operators import corpus, dims, summary
from sectorscope.sources.paths import suffix
from sectorscope.sources.readers import read_csv, read_parquet, read_repos
from sectorscope.sources.writers import write_batch, write_scored

# Adds ``probabilities`` to a table with a ``text`` column.
AddScores = Callable[[DataFrame], DataFrame]


def score_corpus(
    repos: DataFrame,
    add_scores: AddScores,
    labels: DataFrame,
    limit: int | None = None,
    order_by: str | None = None,
    max_readme_chars: int | None = None,
) -> DataFrame:
    """All input columns plus ``predicted_naics``, ``confidence`` and ``naics_description``.

    Whole texts are scored; ``max_readme_chars`` cuts the README for models that take less.
    """
    rows = corpus.take_rows(repos, limit, order_by)
    texts = rows.withColumn("text", corpus.batch_text_column(rows, max_readme_chars))
    scored = cl.classify(add_scores(texts), labels)
    named = dims.batch_description(scored, "predicted_naics")
    return named.select(*repos.columns, "predicted_naics", "confidence", "naics_description")


def score_file(
    spark: SparkSession, source: str, target: str, add_scores: AddScores, labels: DataFrame, limit: int | None = None
) -> DataFrame:
    """Read, score, write once; the summary is taken from the written table."""
    write_batch(score_corpus(read_repos(spark, source), add_scores, labels, limit), target)
    stored = read_csv(spark, target) if suffix(target) == "csv" else read_parquet(spark, target)
    return summary.scoring_summary(stored.withColumn("confidence", F.col("confidence").cast("double")))


def predict_table(repos: DataFrame, add_scores: AddScores, labels: DataFrame, describe: bool = True) -> DataFrame:
    """Scoring with the simple text layout; the long description is optional."""
    texts = repos.withColumn("text", corpus.simple_text_column(repos))
    scored = cl.classify(add_scores(texts), labels)
    columns = [*repos.columns, "predicted_naics", "confidence"]
    if not describe:
        return scored.select(*columns)
    return dims.describe_codes(scored, "predicted_naics").select(*columns, "naics_description")


def predict_file(
    spark: SparkSession, source: str, target: str, add_scores: AddScores, labels: DataFrame, describe: bool = True
) -> DataFrame:
    """Read by file type, score, write by file type; the classes of the written table, counted."""
    write_scored(predict_table(read_repos(spark, source), add_scores, labels, describe), target)
    kind = suffix(target)
    if kind == "json":
        stored = spark.read.schema("predicted_naics string").json(target)
    else:
        stored = read_parquet(spark, target) if kind == "parquet" else read_csv(spark, target)
    return summary.prediction_distribution(stored)


def classify_repositories(repos: DataFrame, add_scores: AddScores, labels: DataFrame) -> DataFrame:
    """Code, industry and confidence in percent for repositories given by their parts."""
    scored = predict_table(repos, add_scores, labels)
    return scored.select(
        *repos.columns,
        F.col("predicted_naics").alias("naics_code"),
        F.col("naics_description").alias("industry"),
        percent(F.col("confidence")).alias("confidence"),
    )
