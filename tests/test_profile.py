import numpy as np
import pytest
from helpers import values

from sectorscope.operators import profile


def counts(spark, lengths):
    df = spark.createDataFrame([("x" * n,) for n in lengths] + [(None,)], "text string")
    return profile.store_length_counts(df)


def test_stats(spark):
    row = profile.length_stats(counts(spark, [1, 2, 3, 10])).first()
    assert (row.min_length, row.max_length, row.mean_length, row.median_length) == (1, 10, 4.0, 2.5)
    assert row.std_length == pytest.approx(4.082483, abs=1e-6)
    assert profile.length_stats(counts(spark, [5])).first().std_length is None
    assert tuple(profile.length_range(counts(spark, [1, 2, 3, 10])).first()) == (1, 10, 4.0)


@pytest.mark.parametrize("lengths", [[1, 2, 3, 10], [7, 7, 7], list(range(0, 301, 3)), [0, 50, 100, 100], [3, 4]])
def test_histogram_matches_numpy(spark, lengths):
    rows = values(profile.length_histogram(counts(spark, lengths)), "bin")
    n, edges = np.histogram(lengths, bins=50)
    assert [r[3] for r in rows] == n.tolist()
    assert np.allclose([r[1] for r in rows] + [rows[-1][2]], edges)


def test_maximum_falls_in_last_bin(spark):
    rows = values(profile.length_histogram(counts(spark, [1, 2, 3, 10])), "bin")
    assert rows[-1][3] == 1 and len(rows) == 50


def test_box(spark):
    lengths = list(range(10, 30)) + [100, 100]
    row = profile.box_numbers(counts(spark, lengths)).first()
    q1, q2, q3 = np.percentile(lengths, [25, 50, 75])
    assert (row.q1, row.median, row.q3) == (q1, q2, q3)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (10.0, 29.0, 2)
    assert values(profile.outliers(counts(spark, lengths))) == [(100, 2)]


def test_class_distribution(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbc"] + [(None,)], "label string")
    assert [(r[0], r[1], round(r[2], 1)) for r in profile.class_distribution(df).collect()] == [
        ("a", 2, 33.3), ("b", 3, 50.0), ("c", 1, 16.7)
    ]
    assert tuple(profile.class_range(df).first()) == (3, 1, 3, 6)


def test_deviation_of_large_close_lengths(spark):
    both = spark.createDataFrame([(200_000, 500_000_000), (200_001, 500_000_000)], "length int, n long")
    assert profile.length_stats(both).first().std_length == pytest.approx(0.5, abs=1e-9)
