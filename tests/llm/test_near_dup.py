import random

import brute
import pytest
from samples import edited, prose

from sectorscope.llm import common, near_dup


def found(docs):
    rows = near_dup.near_duplicates(docs).drop("_id", "_key").collect()
    return sorted(map(tuple, rows), key=str)


def expected(docs):
    return sorted(brute.near_components([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = found(docs)
    assert got == expected(docs)
    assert not all(r[3] for r in got)


def test_odd_rows_and_clashing_columns(odd_docs, clashing):
    assert found(odd_docs) == expected(odd_docs)
    assert found(clashing) == expected(odd_docs)
    kept = near_dup.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in expected(odd_docs) if r[3]}


def test_no_rows(no_docs):
    assert found(no_docs) == []


@pytest.mark.parametrize("small,depth,dense", [(4, 3, 0.25), (2, 1, 0.25), (4, 2, 2.0)])
def test_large_nodes(spark, monkeypatch, small, depth, dense):
    """Groups far over the bound of a node: chains of edits, two near groups, a shared passage."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "DEPTH", depth)
    monkeypatch.setattr(near_dup, "DENSE", dense)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup._Block, "COLUMNS", 7)
    monkeypatch.setattr(near_dup, "HUB_MEMBERS", 8)
    rng, rows = random.Random(5), []
    base, passage = prose(50, 400), prose(51, 150)
    texts = [edited(base, k, rng.randrange(1, 9)) for k in range(60)]
    chain = prose(52, 300)
    for k in range(40):  # each is near the one before, not near the first
        chain = edited(chain, 1000 + k, 3)
        texts.append(chain)
    texts += [prose(600 + k, 90) + " " + passage for k in range(40)]
    rng.shuffle(texts)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == expected(docs)


def test_rows_of_joins_by_node(spark, monkeypatch):
    """The classes of a large node are joined once for their level and once for where they go on."""
    base, rows = prose(60, 120), []
    docs = spark.createDataFrame([(k, edited(base, k, 1 + k % 3)) for k in range(150)], "doc_id long, text string")
    join = type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "path":
            rows.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    got = found(docs)
    monkeypatch.undo()
    assert got == expected(docs)
    assert rows[0] > 1000 and sum(rows) < 2.2 * rows[0]


def test_every_class_meets_the_first_one(spark, monkeypatch):
    """In batches smaller than a node, and in nodes of one group and of many."""
    monkeypatch.setattr(near_dup, "SMALL", 20)
    rng, rows, want = random.Random(6), [], set()
    for path, size in ((-5, 21), (3, 130), (4, 500)):
        first = [rng.randrange(9) for _ in range(near_dup.WIDTH)]
        for k in range(size):
            sig = [x if not k or rng.random() < 0.5 else -1 for x in first]
            n, share = 100 + k % 50, sum(x == y for x, y in zip(sig, first))
            rows.append((path, 1000 + k, size, 1000, n, sig))
            similar = 100 * 100 >= 75 * n and share >= near_dup.LEAST_SHARE * near_dup.WIDTH
            want.add((path, 1000, 1000 + k, share, similar))
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "path long, v long, size long, hub long, n long, sig array<int>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in near_dup._with_hub(given, 75).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want


def test_limit_is_exact(spark):
    """8 words of 4 shingles in common: 3 of 4 together is a link, less is none."""
    words = [f"w{k}" for k in range(40)]
    pairs = []
    for cut in range(30, 40):
        pairs.append((cut, " ".join(words[:cut])))
    docs = spark.createDataFrame([(0, " ".join(words)), *[(100 + a, b) for a, b in pairs[:1]]], "doc_id long, text string")
    assert found(docs) == expected(docs)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert found(docs) == expected(docs)


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, equal ids with near texts, and groups without ids leave one row each."""
    given, same, none, mixed = (prose(k, 200) for k in (80, 81, 82, 83))
    rows = [(1, given, "a")] * 3 + [(2, same, "a"), (2, edited(same, 1, 2), "a"), (2, edited(same, 2, 2), "b")]
    rows += [(None, none, None)] * 2 + [(None, edited(none, 3, 2), None), (None, mixed, "a"), (9, mixed, "b")]
    rows += [(4, "", "a"), (4, "", "a"), (5, "", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in near_dup.keep_first(docs).collect()]
    assert sorted((r[0] for r in kept), key=str) == [1, 2, 4, 5, 9, None, None]
    assert set(kept) <= set(rows) and (9, mixed, "b") in kept and (None, None, "a") in kept


@pytest.mark.parametrize("max_keys", [0, 2, 100])
def test_rows_with_keys(spark, max_keys):
    """Broadcast or shuffled, the same rows."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "v long, x string")
    keys = spark.createDataFrame([(1,), (3,), (7,)], "v long")
    assert sorted(tuple(r) for r in common.with_keys(rows, keys, "v", max_keys).collect()) == [(1, "a"), (1, "b"), (3, "d")]
    assert common.with_keys(rows, keys.where("v > 9"), "v", max_keys).collect() == []
