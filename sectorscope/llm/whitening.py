"""Whitening of embeddings with MLlib's distributed block matrices.

Entries are made whole numbers first (``floor(scale * entry)``), so that counts, sums and distances
are exact.  The fit list holds every distinct vector once.

1. The distinct vectors are numbered, centred and put into a :class:`BlockMatrix` of row blocks.
2. The transposed matrix times the matrix is the scatter.  Row blocks are dealt to several tasks
   per product block, and their products added up.
3. The scatter, of the size of a vector squared, is decomposed on the driver.
4. The block matrix times the whitening matrix projects the rows.  Covariance of the result
   minus the identity is the error, by the same multiplication.

A row whose vector is null or holds a null or non-finite entry is left out, and so is one of
another length than most (of equally frequent lengths the longest counts).  Repeated rows and
vectors each get their own rows; a vector that many rows share is fitted once, and its rows are spread
over tasks.  Null ids stay.  Components without variance are left out, so vectors that are all
equal, or empty, give no rows.  ``deviation`` is null where it exceeds a long.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.numbering import numbered
from sectorscope.operators.sizing import hot_key_join, local_table
from sectorscope.sources.paths import store

ROWS_PER_BLOCK = 1024
COLUMNS_PER_BLOCK = 256
# Row blocks that one task multiplies and adds up.
BLOCKS_PER_TASK = 16
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
# Eigenvalues below this share of the largest one, for each dimension, are rounding.
NOISE = 1e-14
# Exact whole numbers of any sum here.
_EXACT = "decimal(38,0)"


def _whole(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def _usable(embedding: Column) -> Column:
    def bad(c: Column) -> Column:
        c = c.cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    return embedding.isNotNull() & ~F.exists(embedding, bad)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product; blocks along the inner dimension are dealt to ``splits`` tasks for each block of it."""
    # The Python method has no parameter for the splits.
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    splits = -(-matrix.numRowBlocks // BLOCKS_PER_TASK)
    return _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``_n`` and ``values`` (array of doubles) as a block matrix, without leaving the JVM."""
    vectors = rows.select(F.col("_n").alias("index"), array_to_vector("values").alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    matrix = IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS_PER_BLOCK, min(width, COLUMNS_PER_BLOCK))
    # Both products and their plans look at the blocks; lost ones follow again from the stored fit list.
    return matrix.persist(StorageLevel.MEMORY_AND_DISK)


def _local_blocks(spark, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small matrix, such as the whitening one, in row blocks."""
    parts = []
    for k, at in enumerate(range(0, len(matrix), rows_per_block)):
        part = matrix[at : at + rows_per_block]
        parts.append(((k, 0), DenseMatrix(*part.shape, part.flatten(order="F").tolist())))
    blocks = spark.sparkContext.parallelize(parts, 1)
    return BlockMatrix(blocks, rows_per_block, matrix.shape[1], *matrix.shape)


def _rows(matrix: BlockMatrix) -> DataFrame:
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.toDF("_n", "vector").select("_n", vector_to_array("vector").alias("w"))


def principal_axes(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of the covariance, their unit vectors as columns, and its trace."""
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    order = np.argsort(values, kind="stable")[::-1][:components]
    values, axes = values[order], axes[:, order]
    real = values > max(NOISE * len(scatter) * max(values.max(initial=0), 0), 0)
    return values[real], axes[:, real], float(np.trace(scatter)) / n


def _deviation(n: int, sums: list[int], largest: int) -> Column:
    """The sum of (n * x - S)^2 over the dimensions, as n^2 * x.x - 2n * x.S + S.S.

    Whole numbers whose sums stay in a long are added as such, larger ones as decimals; what exceeds
    those is null.
    """
    biggest = max(1, largest, *map(abs, sums))
    kind = "long" if biggest * max(largest, 1) * (len(sums) + 1) < 1 << 62 else _EXACT

    def whole(number: int) -> Column:
        return F.lit(str(number)).try_cast(_EXACT)

    def added(products: Column) -> Column:
        return F.aggregate(products, F.lit(0).cast(kind), lambda a, c: F.try_add(a, c).cast(kind))

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(a, b).cast(kind)

    x = F.transform("x", lambda c: c.cast(kind))
    total = F.array(*[whole(s).cast(kind) for s in sums])
    squares, crossed = added(F.zip_with(x, x, times)), added(F.zip_with(x, total, times))
    exact = F.try_subtract(
        F.try_multiply(squares.cast(_EXACT), whole(n * n)), F.try_multiply(crossed.cast(_EXACT), whole(2 * n))
    )
    return F.try_add(exact, whole(sum(s * s for s in sums))).try_cast("long")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row of ``vectors`` (vec_id, embedding) and component: see ``OUT``.

    Runs jobs: lengths, the fit list, its sums, the scatter, the error.  The driver holds a matrix of
    the vectors' length squared.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], OUT)
    usable = vectors.where(_usable(F.col("embedding"))).select("vec_id", _whole(F.col("embedding"), scale).alias("x"))
    lengths = usable.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("c"))
    common = lengths.agg(F.max(F.struct("c", "size")).alias("m")).first()["m"]
    if common is None or not common["size"]:
        return nothing
    width = common["size"]
    key = F.sha2(F.array_join(F.transform("x", lambda c: c.cast("string")), ","), 256)
    usable = usable.where(F.size("x") == width).select("vec_id", key.alias("key"), "x")

    fit = numbered(usable.groupBy("key").agg(F.first("x").alias("x")), "fit")
    fit = store(fit.select("key", "x", "_n"), "fit-numbered")
    n = fit.count()
    entries = fit.select(F.posexplode("x").alias("at", "c"))
    sums = entries.groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.max(F.abs(F.col("c").cast("decimal(20,0)"))).alias("m"))
    by_place = {r["at"]: r for r in sums.collect()}  # one row for each dimension
    total = [int(by_place[k]["s"]) for k in range(width)]
    largest = max(int(r["m"]) for r in by_place.values())

    mean = F.array(*[F.lit(float(Fraction(s, n))) for s in total])
    centred = fit.select("_n", F.zip_with("x", mean, lambda a, b: a.cast("double") - b).alias("values"))
    matrix = _blocks(centred, n, width)
    values, axes, trace = principal_axes(_scatter(matrix), n, components)
    if not len(values):
        return nothing
    projected = _times(matrix, _local_blocks(spark, axes / np.sqrt(values), matrix.colsPerBlock), 1)
    projected.persist(StorageLevel.MEMORY_AND_DISK)
    error = float(np.abs(_scatter(projected) / n - np.eye(len(values))).max())

    white = store(_rows(projected), "whitened")
    share = [(k, float(v / trace)) for k, v in enumerate(values)]
    fitted = fit.join(white, "_n").select("key", _deviation(n, total, largest).alias("deviation"), "w")
    each = hot_key_join(usable.select("vec_id", "key"), fitted, "key")
    rows = each.select("vec_id", "deviation", F.posexplode("w").alias("_k", "whitened"))
    shares = local_table(spark, share, "_k int, explained double")
    return rows.join(F.broadcast(shares), "_k").select(
        "vec_id",
        (F.col("_k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )
