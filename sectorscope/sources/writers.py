"""Writers.  Every writer replaces its target folder and runs on the executors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.operators.classify import model_codes
from sectorscope.operators.sizing import local_table
from sectorscope.sources.paths import suffix
from sectorscope.sources.readers import LABEL_SCHEMA, read_label_json, read_parquet


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; outer blanks of texts are kept."""
    writer = _flat(df).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Write by file type: csv, json (one object per line) or parquet; anything else as csv."""
    kind = suffix(path)
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        write_csv(df, path)


def write_batch(df: DataFrame, path: str) -> None:
    """Bulk scoring output: csv by name, parquet otherwise."""
    if suffix(path) == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_first_use(df: DataFrame, path: str) -> DataFrame:
    """Persist the first-use table and continue from the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return read_parquet(df.sparkSession, path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("label", "code").write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, labels: DataFrame | None, path: str) -> None:
    """Model folder with the label map beside it."""
    model.write().overwrite().save(f"{path}/model")
    if labels is not None:
        write_labels(labels, f"{path}/labels")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """Model and label map; without a stored map the model's own one is used."""
    model = PipelineModel.load(f"{path}/model")
    return model, load_labels(spark, path, model)


def load_labels(spark: SparkSession, path: str, model: PipelineModel | None = None) -> DataFrame:
    if suffix(path) == "json":
        return read_label_json(spark, path)
    try:
        return read_parquet(spark, f"{path}/labels")
    except FileNotFoundError:
        if model is None:
            raise
        return local_table(spark, list(enumerate(model_codes(model))), LABEL_SCHEMA)


def write_report(metrics: DataFrame, report: DataFrame, test_size: DataFrame, path: str) -> None:
    """Evaluation report: metric row, class report, size of the test set."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    report.write.mode("overwrite").parquet(f"{path}/classes")
    test_size.write.mode("overwrite").parquet(f"{path}/test_size")
