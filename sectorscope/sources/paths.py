"""Where derived tables may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared one that the deployment names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/sectorscope-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and go on from the stored copy.

    Cuts the lineage: later jobs neither recompute it nor lose it with an executor.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def suffix(path: str) -> str:
    """File type by the end of the name: ``csv``, ``json``, ``parquet`` or ''."""
    last = str(path).rstrip("/").rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""
