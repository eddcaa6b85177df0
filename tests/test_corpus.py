import pytest
from helpers import values
from pyspark.sql import functions as F

from sectorscope.operators import corpus, sizing, split
from sectorscope.plans.prepare import prepare_corpus


def repos(spark):
    rows = [(i, c, f"r{i}") for i, c in enumerate(["62", "11", "31-33", "44-45", "62", None, "11", "62"])]
    return spark.createDataFrame(rows, "id int, code string, name_repo string")


def test_label_ids_follow_string_order(spark):
    assert values(corpus.label_dim(repos(spark)), "label") == [(0, "11"), (1, "31-33"), (2, "44-45"), (3, "62")]


def test_numeric_targets_become_text(spark):
    df = spark.createDataFrame([(52,), (None,)], "code int")
    assert values(corpus.drop_null_target(df)) == [("52",)]


@pytest.mark.parametrize("bound", [0, 100_000])
def test_class_filter_and_labels(spark, bound, monkeypatch):
    """The result is the same when the class list is too long to broadcast."""
    monkeypatch.setattr(sizing.lookup_join, "__defaults__", (bound,))
    monkeypatch.setattr(sizing.settle, "__defaults__", (bound,))
    prepared, labels = prepare_corpus(repos(spark), min_samples=2, keep=["id"])
    assert values(labels, "label") == [(0, "11"), (1, "62")]
    assert values(prepared.select("id", "text", "label"), "id") == [
        (0, "Repository: r0", 1), (1, "Repository: r1", 0), (4, "Repository: r4", 1), (6, "Repository: r6", 0), (7, "Repository: r7", 1)
    ]
    kept = corpus.keep_frequent_classes(repos(spark), "code", 2)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert values(corpus.excluded_classes(repos(spark).na.drop(), "code", 2), "code") == [("31-33", 1), ("44-45", 1)]


def test_given_labels_are_kept(spark):
    """Ids come from the stored map even if a class in between is missing from the data."""
    stored = spark.createDataFrame([(0, "11"), (5, "62")], "label int, code string")
    prepared, _ = prepare_corpus(repos(spark), labels=stored, keep=["id"])
    assert {r.id: r.label for r in prepared.collect()} == {0: 5, 1: 0, 4: 5, 6: 0, 7: 5}


def test_filter_report(spark):
    assert values(corpus.filter_report(repos(spark), "code", 2), "seq") == [
        (0, "original", 8, 4), (1, "target_present", 7, 4), (2, "class_filter", 5, 2)
    ]


def test_attach_code_accepts_text_and_unknown_ids(spark):
    labels = spark.createDataFrame([(0, "11"), (10, "62")], "label int, code string")
    df = spark.createDataFrame([("0",), ("10",), ("7",), ("x",)], "class_index string")
    assert [r.predicted_naics for r in corpus.attach_code(df, labels).collect()] == ["11", "62", "7", "x"]


def test_take_rows(spark):
    df = spark.range(10)
    assert corpus.take_rows(df, 0).count() == 10
    assert corpus.take_rows(df, None).count() == 10
    assert [r.id for r in corpus.take_rows(df, 3, "id").collect()] == [0, 1, 2]


# --- joins -----------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, how):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 90).alias("k"), "id"
    )
    unique = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = big.join(unique, "k", how)
    assert sizing.hot_keys(big, "k", min_rows=500) == [7]
    split_ = sizing.hot_key_join(big, unique, "k", how, min_rows=500)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split_.collect()))


def test_hot_key_join_with_repeated_partners(spark, monkeypatch):
    big = spark.range(600).select((F.col("id") % 2).alias("k"), "id")
    twice = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    want = sorted(map(str, big.join(twice, "k").collect()))
    for bound in (100_000, 1):
        monkeypatch.setattr(sizing.settle, "__defaults__", (bound,))
        assert sorted(map(str, sizing.hot_key_join(big, twice, "k", min_rows=100).collect())) == want


def test_no_task_gets_a_whole_hot_key(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    other = spark.range(9000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = sizing.hot_key_join(big, other, "k", min_rows=1000)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = joined.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(r["count"] for r in parts) == 3001 and max(r["count"] for r in parts) < 2000


def test_settle_bound(spark):
    assert sizing.settle(spark.range(5), 5)[1] is True
    df, small = sizing.settle(spark.range(6), 5)
    assert small is False and df.count() == 6


# --- split ------------------------------------------------------------------------------------
def test_split_sizes():
    assert split.split_sizes(6588) == (4611, 659, 1318)


def test_quotas_use_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "label string, n long")
    got = split.class_quotas(counts, "label", "n", F.lit(2), "q")
    assert {r.label: r.q for r in got.collect()} == {"a": 1, "b": 1, "c": 0}


def brute_force(rows, test_size, val_size, seed):
    """Rank every class by its order key, on the driver."""
    import hashlib
    from collections import Counter, defaultdict

    n_train, n_val, n_test = split.split_sizes(len(rows), test_size, val_size)

    def quotas(sizes, seats):
        total = sum(sizes.values())
        whole = {c: s * seats // total for c, s in sizes.items()}
        by_rest = sorted(sizes, key=lambda c: (-(sizes[c] * seats % total), c))
        for c in by_rest[: seats - sum(whole.values())]:
            whole[c] += 1
        return whole

    sizes = Counter(c for _, c in rows)
    test = quotas(sizes, n_test)
    val = quotas({c: sizes[c] - test[c] for c in sizes}, n_val)
    ranked = defaultdict(list)
    for i, c in rows:
        ranked[c].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    out = {}
    for c, keys in ranked.items():
        for pos, (_, i) in enumerate(sorted(keys)):
            out[i] = "test" if pos < test[c] else "validation" if pos < test[c] + val[c] else "train"
    return out


@pytest.mark.parametrize("digits, bound", [(3, 100_000), (1, 100_000), (1, 0)])
def test_split_equals_brute_force(spark, digits, bound, monkeypatch):
    """One class holds most rows; few buckets and shuffle joins must not change anything."""
    monkeypatch.setattr(split, "BUCKET_DIGITS", digits)
    monkeypatch.setattr(sizing.lookup_join, "__defaults__", (bound,))
    monkeypatch.setattr(sizing.settle, "__defaults__", (bound,))
    rows = [(i, "big" if i % 3 else ("m" if i % 2 else f"s{i % 5}")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = split.stratified_split(df, seed=7)
    assert {r.id: r.split for r in got.collect()} == brute_force(rows, 0.2, 0.1, 7)


def test_split_keeps_null_quota_classes_in_train(spark):
    rows = [(i, "a") for i in range(200)] + [(1000, "b"), (1001, "b")]
    df = spark.createDataFrame(rows, "id long, label string")
    got = split.stratified_split(df, validate=False)
    assert got.count() == 202
    assert {r.id: r.split for r in got.collect()} == brute_force(rows, 0.2, 0.1, 42)


def test_split_rejects_small_classes(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(50)], "id long, label string")
    with pytest.raises(ValueError, match="too few rows"):
        split.stratified_split(df)
    with pytest.raises(ValueError, match="empty"):
        split.stratified_split(df.limit(0))
    many = spark.createDataFrame([(i, f"c{i // 2}") for i in range(40)], "id long, label string")
    with pytest.raises(ValueError):
        split.stratified_split(many)


def test_split_rejects_repeated_ids(spark):
    df = spark.createDataFrame([(i // 100, "a") for i in range(300)], "id long, label string")
    with pytest.raises(Exception, match="must be unique"):
        split.stratified_split(df).collect()


def test_bucket_digits_follow_the_rows():
    assert split.bucket_digits(10) == 3
    assert split.bucket_digits(10**11) == 5
