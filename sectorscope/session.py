"""Session settings.

On a cluster the deployment owns master, memory and the shared folder named by
``spark.checkpoint.dir``; only settings the results or the plans depend on are set here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Results depend on the first one; the others shape the physical plans.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Writing the three splits side by side needs no sort of the texts by split.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_settings(shuffle_bytes: int) -> dict[str, str]:
    """Start with partitions of about 128 MB for the largest expected shuffle.

    Adaptive execution merges what turns out smaller, but it cannot split an even partition
    that is too large, so the start value has to be high enough.
    """
    partitions = max(200, -(-shuffle_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
    }


def build_session(
    app_name: str = "sectorscope", shuffle_bytes: int = 0, settings: dict[str, str] | None = None
) -> SparkSession:
    """Session for spark-submit.

    ``shuffle_bytes`` is the expected size of the largest shuffle: for adoption the distinct
    (repository, first use) pairs, for everything else next to nothing.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RESULT_SETTINGS, **shuffle_settings(shuffle_bytes), **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """Single-JVM session for tests and the bench.

    ``scratch`` is used as checkpoint folder only where the environment names none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sectorscope-local")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if scratch and not spark.conf.get("spark.checkpoint.dir", ""):
        spark.conf.set("spark.checkpoint.dir", scratch)
    return spark
