"""Whitening against numpy over all rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import VECTORS

from sectorscope.llm.queries import QUERIES
from sectorscope.llm.whitening import whiten


def brute(rows, width):
    """For each usable row: id, vector of whole numbers; and the statistics of the distinct ones."""
    usable = []
    for vec_id, vector, *_ in rows:
        if vector is None or len(vector) != width or any(c is None or not math.isfinite(c) for c in vector):
            continue
        usable.append((vec_id, tuple(math.floor(256 * float(np.float32(c))) for c in vector)))
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    return usable, n, sums, values[order], axes[:, order]


def check(found, rows, width, components=4):
    usable, n, sums, values, axes = brute(rows, width)
    by_row = defaultdict(list)
    for r in found:
        by_row[(r["vec_id"], r["component"])].append(r)
    assert sum(map(len, by_row.values())) == len(usable) * min(components, len(values))
    signs = {}
    for vec_id, x in usable:
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        white = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        for k in range(min(components, len(values))):
            matching = [r for r in by_row[(vec_id, k + 1)] if r["deviation"] == exact]
            assert matching
            r = matching[0]
            assert r["n"] == n
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            assert abs(r["whitened"]) == pytest.approx(abs(white[k]), abs=1e-7)
            if abs(white[k]) > 1e-6:
                sign = np.sign(white[k] * r["whitened"])
                assert signs.setdefault(k, sign) == sign


def test_odd_vectors(spark, odd_dir):
    table = spark.read.parquet(f"{odd_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    check(QUERIES["op11_embedding_whitening"](spark, odd_dir).collect(), rows, 5)
    clashing = table.withColumns({c: F.lit(1) for c in ("x", "key", "_n", "_size", "n", "w", "index", "vector", "a.b")})
    check(whiten(clashing).collect(), rows, 5)


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op11_embedding_whitening"](spark, sf_dir).collect(), rows, 64)


def test_several_blocks_each_way(spark, monkeypatch):
    from sectorscope.llm import whitening

    for name, value in {"ROWS_PER_BLOCK": 7, "COLUMNS_PER_BLOCK": 3, "BLOCKS_PER_TASK": 2}.items():
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(0, 1 + np.arange(8))], 0) for k in range(50)]
    check(whiten(spark.createDataFrame(rows, VECTORS), components=6).collect(), rows, 8, components=6)


def test_nothing_to_whiten(spark):
    same = [(k, [0.5, 0.25], 0) for k in range(4)]
    assert whiten(spark.createDataFrame(same, VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], VECTORS)).collect() == []


def test_components_without_variance_and_one_dimension(spark):
    line = [(k, [float(k), float(2 * k), 1.0], 0) for k in range(5)]
    found = whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 5
    one = [(k, [float(k)], 0) for k in range(4)]
    check(whiten(spark.createDataFrame(one, VECTORS)).collect(), one, 1)


def test_large_entries_stay_exact_or_null(spark):
    """Distances beyond doubles are exact; beyond longs they are null."""
    rows = [(k, [1e2 * k + 0.5, -3e3 * (k % 7), 7.0 * k * k], 0) for k in range(40)]
    check(whiten(spark.createDataFrame(rows, VECTORS)).collect(), rows, 3, components=3)
    huge = [(k, [1e30 * k, 1.0 * k], 0) for k in range(5)]
    found = whiten(spark.createDataFrame(huge, VECTORS)).collect()
    assert found and any(r["deviation"] is None for r in found)
