"""Extendible hashing: documents into shards of bounded size.

A document's key is 60 bits of an MD5 over its id and text.  A shard is a prefix of the key:
all documents start in the shard of the empty prefix, and only a shard over the byte limit
splits on its next bit.  The directory lists the shard of every prefix of ``depth`` bits.

The bytes are counted once per prefix of the first directory depth, which follows from the
total; the sizes of all shorter prefixes are sums over those counts, so the directory, a few
entries per shard, is all that is worked on.  Only documents of prefixes that are still too
large take part in the next doubling.

A document over the limit cannot be split: it gets a shard of its own, marked
``over_limit``.  Rows repeated in id and text have equal keys; where such a group alone is
over the limit, its rows go on splitting by the hash of their row number.  Null id or text:
hashed as such, no bytes.  Extra columns are ignored by :func:`assign_shards` and written by
:func:`write_shards`.  An empty table gives no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import quoted
from sectorscope.sources.paths import store

KEY_BITS = 60
STEP_BITS = 8


def shard_key(doc_id: Column, text: Column) -> Column:
    """First 60 bits of the MD5 of id and text, as a long."""
    parts = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(text), F.lit("-"))
    )
    return F.conv(F.substring(F.md5(parts), 1, KEY_BITS // 4), 16, 10).cast("long")


def _round(rows: DataFrame, start: int, depth: int, max_bytes: int) -> DataFrame:
    """Adds ``_leaf``, the shard's depth in ``start``..``depth``, or null where still open.

    ``_head`` names the shard that the bits are counted from.
    """
    at = F.shiftright(F.col("_bits"), KEY_BITS - depth)
    rows = rows.withColumn("_bucket", at)
    counts = rows.groupBy("_head", "_bucket").agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_docs"))
    paths = counts.withColumn("_depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn(
        "_prefix", F.expr(f"shiftright(_bucket, {depth} - _depth)")
    )
    fits = (
        paths.groupBy("_head", "_depth", "_prefix")
        .agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_docs").alias("shard_docs"))
        .where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1))
    )
    shard = F.struct("_depth", "shard_bytes", "shard_docs")
    directory = (
        paths.join(fits, ["_head", "_depth", "_prefix"])
        .groupBy("_head", "_bucket")
        .agg(F.min(shard).alias("_leaf"))
    )
    return rows.join(directory, ["_head", "_bucket"], "left").drop("_bucket")


def _assign(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows: ``_row``, ``doc_id``, ``n_bytes``, ``_key``.  Runs jobs: one total, one per doubling."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes))) + 2))
    open_rows = rows.withColumn("_bits", F.col("_key")).withColumn("_head", F.lit(""))
    start, done = 0, None
    while True:
        step = store(_round(open_rows, start, depth, max_bytes), "shards")
        prefix = F.lpad(F.bin(F.expr(f"shiftright(_bits, {KEY_BITS} - _leaf._depth)")), F.col("_leaf._depth"), "0")
        closed = step.where(F.col("_leaf").isNotNull()).select(
            "_row",
            "doc_id",
            "n_bytes",
            F.concat("_head", F.when(F.col("_leaf._depth") > 0, prefix).otherwise("")).alias("shard"),
            "_leaf.shard_bytes",
            "_leaf.shard_docs",
        )
        done = closed if done is None else done.unionByName(closed)
        left = step.where(F.col("_leaf").isNull()).drop("_leaf")
        if left.isEmpty():
            break
        start, depth = depth + 1, min(KEY_BITS, depth + STEP_BITS)
        open_rows = left
        if start > KEY_BITS:  # equal keys: go on with bits of the row number
            full = F.lpad(F.bin("_bits"), KEY_BITS, "0")
            bits = F.shiftrightunsigned(F.xxhash64("_row"), 64 - KEY_BITS)
            open_rows = left.withColumn("_head", F.concat("_head", full)).withColumn("_bits", bits)
            start, depth = 0, STEP_BITS
    return done.withColumn("over_limit", F.col("shard_bytes") > max_bytes).withColumn(
        "depth", F.length("shard").cast("int")
    )


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        shard_key(F.col("doc_id"), F.col("text")).alias("_key"),
    )


def assign_shards(docs: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``shard`` (its prefix in bits), ``depth``,
    ``shard_bytes``, ``shard_docs``, ``over_limit``."""
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    return _assign(store(_numbered(docs), "shard-keys"), max_bytes).drop("_row")


def write_shards(docs: DataFrame, path: str, max_bytes: int = 256 << 20) -> None:
    """Write the documents, all their columns, as Parquet under ``path/shard=<prefix>``.

    Each shard is written by one task, whose input is bounded by ``max_bytes`` (or is one
    document).  The empty prefix is written as ``all``.
    """
    kept = store(
        docs.select(
            F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    keys = kept.select(
        "_row",
        F.col("_doc.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("_doc.text"), F.lit(0)).cast("long").alias("n_bytes"),
        shard_key(F.col("_doc.doc_id"), F.col("_doc.text")).alias("_key"),
    )
    shards = _assign(store(keys, "shard-keys"), max_bytes).select("_row", "shard")
    name = F.when(F.col("shard") == "", "all").otherwise(F.concat(F.lit("b"), "shard"))
    rows = kept.join(shards, "_row").select("_doc.*", name.alias("shard"))
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
