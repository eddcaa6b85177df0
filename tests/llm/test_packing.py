import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorscope.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity):
    """The pieces are the documents' ids in order; sequences are gapless and within capacity."""
    tokenizer, want = tokens.open_tokenizer(PATH), []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        size = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(size, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity,block", [(2048, 16384), (64, 16)])
def test_documents(spark, odd_docs, clashing, sf_dir, capacity, block):
    given_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (odd_docs, clashing, given_docs):
        rows = packing.pack_documents(docs, PATH, capacity, block=block).collect()
        used, least = check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], capacity)
        assert used <= least * 1.05 + 2


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs, PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=80))
def test_pack(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    before = packing.best_fit(lengths, 100)
    bins = packing.pack(lengths, 100)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert -(-int(lengths.sum()) // 100) <= len(bins) <= len(before)


def fewest(lengths, capacity):
    """The least number of bins, by trying every bin for every piece."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0] and lengths:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms) if room >= lengths[k]}.values():
            place(k + 1, [room - lengths[k] * (i == j) for j, room in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(15, 60), max_size=9))
def test_against_all_packings(lengths):
    """No bound is above the least number of bins; the search is at most one bin over it here."""
    least, lengths = fewest(lengths, 100), np.array(lengths, dtype=np.int64)
    assert packing.least_bins(lengths, 100) <= least <= len(packing.pack(lengths, 100)) <= least + 1


def test_search_empties_a_bin():
    """Best fit leaves four bins where three do; each kind of exchange helps."""
    lengths = np.array([50, 30, 20, 45, 35, 20, 40, 40, 20])
    bad = [[0, 3], [1, 4, 6], [2, 5, 8], [7]]
    assert len(packing._Search(lengths, [list(b) for b in bad], 100).run()) == 3


@pytest.mark.parametrize("low,high,saved", [(300, 700, 20), (500, 900, 40), (600, 1000, 15)])
def test_saves_bins_where_best_fit_is_poor(low, high, saved):
    lengths = np.random.default_rng(1).integers(low, high, 2048)
    bins, before = packing.pack(lengths, 2048), len(packing.best_fit(lengths, 2048))
    assert sorted(k for b in bins for k in b) == list(range(2048))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    assert len(bins) <= before - saved


@pytest.mark.parametrize("lengths", [[], [100], [100] * 7, [1] * 250, [51] * 9, [50] * 9, [99, 1, 99, 1, 2]])
def test_ties_and_edges(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    assert len(packing.pack(lengths, 100)) == packing.least_bins(lengths, 100)


def test_close_to_the_least_number():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 2048, 5000)
    assert len(packing.pack(lengths, 2048)) <= -(-int(lengths.sum()) // 2048) * 1.01
