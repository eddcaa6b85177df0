"""Exact stratified train / validation / test split without sorting whole classes.

Every row gets a uniform order key, the md5 of seed and id.  A class may hold a third of all
rows, so it is never ranked in one place.  Instead:

0. write class and key of every row once; steps 1 to 3 read only these;
1. count rows per (class, first hex digits of the key): a small histogram;
2. per class, find the buckets in which the test and validation quotas run out;
3. rank only the keys inside those buckets to get the exact cut key per class;
4. compare each row's key with the two cut keys of its class: no shuffle, texts stay put.

The rows are scanned twice, for the keys and for the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.operators.sizing import lookup_join, settle
from sectorscope.sources.paths import store

# Keys are counted by their first hexadecimal digits: at least so many, and as many more as keep
# the keys that share them, which one task ranks, to about so many.
BUCKET_DIGITS = 3
BUCKET_ROWS = 100_000


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_sizes(n: int, test_size: float = 0.2, val_size: float = 0.1) -> tuple[int, int, int]:
    """(train, validation, test) row counts; test is taken first, validation from the rest."""
    n_test = math.ceil(test_size * n)
    n_val = math.ceil(val_size / (1 - test_size) * (n - n_test))
    return n - n_test - n_val, n_val, n_test


def class_quotas(counts: DataFrame, label: str, size: str, seats: Column, out: str) -> DataFrame:
    """Split ``seats`` over the classes in proportion to ``size``.

    Whole shares first, then one seat each by largest remainder, ties by label.  ``counts``
    has one row per class, which is all that the windows without a partition ever see.
    """
    everyone = Window.partitionBy()
    share = F.col(size).cast("decimal(20,0)") * seats.cast("decimal(18,0)")
    total = F.sum(size).over(everyone).cast("decimal(20,0)")
    open_seats = seats.cast("long") - F.sum("_whole").over(everyone)
    by_rest = F.row_number().over(Window.orderBy(F.desc("_left"), F.asc(label)))
    return (
        counts.withColumns({"_share": share, "_total": total})
        .withColumn("_left", F.col("_share") % F.col("_total"))
        .withColumn("_whole", ((F.col("_share") - F.col("_left")) / F.col("_total")).cast("long"))
        .withColumns({"_open": open_seats, "_rank": by_rest})
        .withColumn(out, F.col("_whole") + (F.col("_rank") <= F.col("_open")).cast("long"))
        .drop("_share", "_total", "_left", "_whole", "_open", "_rank")
    )


def _class_plan(counts: DataFrame, label: str, test_size: float, val_size: float) -> DataFrame:
    """Per class: rows, test quota, validation quota."""
    everyone = Window.partitionBy()
    seats = counts.withColumn("_all", F.sum("n").over(everyone)).withColumn(
        "_test_seats", F.ceil(F.lit(test_size) * F.col("_all"))
    )
    seats = class_quotas(seats, label, "n", F.col("_test_seats"), "n_test")
    seats = seats.withColumn("_rest", F.col("n") - F.col("n_test")).withColumn(
        "_val_seats", F.ceil(F.lit(val_size / (1 - test_size)) * (F.col("_all") - F.col("_test_seats")))
    )
    return class_quotas(seats, label, "_rest", F.col("_val_seats"), "n_val").select(label, "n", "n_test", "n_val")


def _check(classes: DataFrame) -> None:
    """A class needs two rows in each of the two draws, and each part one seat per class."""
    row = classes.agg(
        F.count("*").alias("k"),
        F.min("n").alias("least"),
        F.min(F.col("n") - F.col("n_test")).alias("least_rest"),
        F.sum("n_test").alias("n_test"),
        F.sum("n_val").alias("n_val"),
        F.sum(F.col("n") - F.col("n_test")).alias("n_rest"),
    ).first()
    if not row["k"]:
        raise ValueError("Cannot split an empty table")
    if row["least"] < 2 or row["least_rest"] < 2:
        raise ValueError("Cannot split: the smallest class has too few rows")
    parts = (row["n_test"], row["n_rest"], row["n_val"], row["n_rest"] - row["n_val"])
    if min(parts) < row["k"]:
        raise ValueError(f"Cannot split: a part has fewer rows than the {row['k']} classes")


def _quota_edges(hist: DataFrame, label: str, test_size: float, val_size: float) -> DataFrame:
    """Per class: sizes, and for each of the two cuts the bucket in which its quota runs out
    and how many keys of that bucket still belong to it."""
    plan = _class_plan(hist.groupBy(label).agg(F.sum("_n").alias("n")), label, test_size, val_size)
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_bucket"))
    seen = hist.withColumn("_upto", upto).join(plan, label)

    def edge(quota: Column, name: str) -> list[Column]:
        here = (F.col("_upto") >= quota) & (F.col("_upto") - F.col("_n") < quota)
        return [
            F.max(F.when(here, F.col("_bucket"))).alias(f"{name}_bucket"),
            F.max(F.when(here, quota - F.col("_upto") + F.col("_n"))).alias(f"{name}_need"),
        ]

    test, both = F.col("n_test"), F.col("n_test") + F.col("n_val")
    sizes = [F.first(c).alias(c) for c in ("n", "n_test", "n_val")]
    return seen.groupBy(label).agg(*sizes, *edge(test, "test"), *edge(both, "val"))


def bucket_digits(rows: int) -> int:
    """Digits by which ``rows`` keys, even if all are of one class, fall into small buckets."""
    digits = BUCKET_DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def split_plan(
    df: DataFrame,
    label: str = "label",
    id_col: str = "id",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    validate: bool = True,
) -> DataFrame:
    """Cut keys per class: ``(label, test_cut, val_cut)``.

    A row is in test up to and including ``test_cut``, in validation up to ``val_cut``.
    Runs jobs: the keys are stored, and the class quotas fetched.
    """
    keys = df.where(F.col(label).isNotNull()).select(F.col(label), order_key(id_col, seed).alias("_key"))
    keys = store(keys, "split-keys")
    # The count comes from the stored files' footers.
    bucket = F.left(F.col("_key"), F.lit(bucket_digits(keys.count())))
    hist = keys.groupBy(label, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    classes, _ = settle(_quota_edges(hist, label, test_size, val_size))
    if validate:
        _check(classes)

    both = F.array_distinct(F.array_compact(F.array("test_bucket", "val_bucket")))
    edges = classes.withColumn("_bucket", F.explode(both)).select(
        F.concat_ws("/", F.col(label).cast("string"), "_bucket").alias("_edge"),
        F.when(F.col("_bucket") == F.col("test_bucket"), F.col("test_need")).alias("test"),
        F.when(F.col("_bucket") == F.col("val_bucket"), F.col("val_need")).alias("val"),
    )
    edge_keys = lookup_join(
        keys.withColumn("_edge", F.concat_ws("/", F.col(label).cast("string"), bucket)), edges, "_edge", "inner"
    )
    # Equal ids collapse here, so a repeated id cannot make a hot group.
    ranked = (
        edge_keys.groupBy(label, "_edge", "_key")
        .agg(F.count("*").alias("_n"), F.first("test").alias("test"), F.first("val").alias("val"))
        .withColumn("_upto", F.sum("_n").over(Window.partitionBy("_edge").orderBy("_key")))
    )

    def cut(need: str) -> Column:
        reached = (F.col("_upto") >= F.col(need)) & (F.col("_upto") - F.col("_n") < F.col(need))
        exact = F.when(F.col("_upto") == F.col(need), F.col("_key")).otherwise(
            F.raise_error(F.lit(f"Column {id_col} repeats at a split boundary; it must be unique"))
        )
        return F.max(F.when(reached, exact))

    return ranked.groupBy(label).agg(cut("test").alias("test_cut"), cut("val").alias("val_cut"))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    id_col: str = "id",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    validate: bool = True,
) -> DataFrame:
    """Add ``split`` in {train, validation, test}; ``id_col`` must identify rows.  Runs jobs."""
    cuts = split_plan(df, label, id_col, test_size, val_size, seed, validate)
    part = (
        F.when(F.col("_key") <= F.col("test_cut"), F.lit("test"))
        .when(F.col("_key") <= F.col("val_cut"), F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    keyed = df.where(F.col(label).isNotNull()).withColumn("_key", order_key(id_col, seed))
    return lookup_join(keyed, cuts, label, "left").withColumn("split", part).select(*df.columns, "split")
