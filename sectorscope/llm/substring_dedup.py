"""Substring dedup: repeats of ``window`` words or more, by seed and extend on winnowed anchors.

Words are taken unchanged.  Every window has one anchor: of the runs of ``ANCHOR`` words in it,
the one with the least hash, the last of equals.  The choice depends on the window's words
alone, so equal windows have equal anchors at equal places, and a text's windows fall into
stretches with a common anchor (winnowing).

1. **Seeds.** Anchors are counted over all documents; a stretch whose anchor occurs once
   holds no repeated window and is dropped.
2. **Extend both ways, whole stretches first.** A stretch reaches as far to either side of its
   anchor as the anchor governs.  Stretches that agree over that whole length (exact copies,
   the inside of long passages, whatever the number of documents) are equal; they collapse to
   one, and all of their words are repeated.
3. **Extend partly.** Where an anchor has different stretches, one of each kind is taken up
   again from its text and grown window by window; a window that another kind holds too is
   a repeat, so a match ends where the texts part.
4. **Maximal repeats.** A document's repeated windows are joined into maximal runs, and the
   words they cover are removed.

Nothing is ever paired within a group: a group of n stretches costs n rows.  Anchors with
``HOT_ROWS`` stretches or more, and one in ``HOT_PARTS`` of all repeated ones, are salted in every
join, so no anchor, however frequent, meets in one task.  Equality is that of
two independent 64-bit hashes.  All repeats are removed, the first occurrence too, and judged
on the input.  Null or empty text: no words.  Rows repeated in id and text repeat each other: a
window of one starts in the other as well.  Null ids are like others; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import content_key
from sectorscope.llm.hashing import column_bytes, mix, row_slices, run_hashes, word_hashes, word_spans
from sectorscope.sources.paths import store

WINDOW = 35
ANCHOR = 5
# An anchor is hot from so many stretches on, if that is at least this part of all.
HOT_ROWS = 10_000
HOT_PARTS = 10_000
SALTS = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_FIRST = (1 << 32) - 1


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (1 << 64) - 1), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Texts:
    """Word hashes of a column of texts, and hashes of any run of its words."""

    def __init__(self, column: pa.Array, window: int):
        self.window = window
        data, bounds = column_bytes(column)
        self.data, self.bounds = data, bounds
        self.starts, self.ends, self.rows = word_spans(data, bounds)
        self.words = word_hashes(data, self.starts, self.ends)
        n = len(self.words) + 1
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.words * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words ``start`` to ``end`` (of the whole column)."""
        with np.errstate(over="ignore"):
            value = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(value + (end - start).astype(np.uint64))

    def stretches(self) -> tuple[np.ndarray, ...]:
        """Row, first window (in the row), number of windows, anchor's place in the first window,
        anchor hash, hash of the whole stretch; of all stretches."""
        window, anchor = self.window, min(ANCHOR, self.window)
        grams = run_hashes(self.words, anchor)
        count = len(self.words) - window + 1
        if count <= 0:
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
        # The place of the least of the runs in each window, by doubling; the last of equals.
        width, span, best = window - anchor + 1, 1, np.arange(len(grams))
        while span < width:
            step = min(span, width - span)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(grams[right] <= grams[left], right, left)
            span += step
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.rows))[:count]
        whole = np.arange(count) + window <= self.rows[1:][row]  # the window ends in its row
        place = np.flatnonzero(whole)
        at = best[place]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (row[place][1:] != row[place][:-1])
        first = np.flatnonzero(new)
        begin = place[first]
        number = np.diff(np.append(first, len(place)))
        offset = at[first] - begin
        with np.errstate(over="ignore"):
            stretch = mix(self.run(begin, begin + number + window - 1) + (offset * 64 + number).astype(np.uint64))
        own = row[begin]
        return own, begin - self.rows[own], number, offset, mix(grams[at[first]]), stretch


def _long(array: np.ndarray) -> pa.Array:
    return pa.array(array.view(np.int64) if array.dtype == np.uint64 else array.astype(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key`` and 16 further bits in ``_tag`` tell documents apart."""
    return docs.select(
        F.col("doc_id").alias("_id"),
        content_key(F.col("doc_id"), F.col("text")).alias("_key"),
        F.shiftright(F.xxhash64(F.col("text"), F.lit("tag"), F.col("doc_id")), 48).alias("_tag"),
        F.col("text").alias("_text"),
    )


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """``h`` (anchor), ``stretch``, ``key``, ``place``: tag, anchor's place, windows and first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                row, first, number, offset, anchor, stretch = Texts(rows.column("_text"), window).stretches()
                tag = rows.column("_tag").to_numpy()[row]
                place = (tag << 48) | (offset << 40) | (number << 32) | first
                key = rows.column("_key").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [_long(anchor), _long(stretch), _long(key), _long(place)], ["h", "stretch", "key", "place"]
                )

    return _keyed(docs).select("_key", "_tag", "_text").mapInArrow(run, "h long, stretch long, key long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with compressed texts, for joins that move them."""
    keyed = _keyed(docs)
    schema = keyed.select("_id", "_key", "_tag", F.lit(b"").alias("_packed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                packed = [_pack(t) for t in rows.column("_text").cast(pa.binary()).to_pylist()]
                columns = [rows.column(c) for c in ("_id", "_key", "_tag")] + [pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "_tag", "_packed"])

    return keyed.mapInArrow(run, schema)


def _pack(text: bytes | None) -> bytes:
    return len(text).to_bytes(8, "little") + _codec().compress(text, asbytes=True) if text else b""


def _unpack(packed: bytes) -> bytes:
    return _codec().decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True) if packed else b""


def _unpacked_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for rows in row_slices(batch, "_packed", max_rows=256, max_bytes=1 << 20):
            yield rows, pa.array([_unpack(p) for p in rows.column("_packed").to_pylist()], pa.large_binary())


def _grown(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """``h``, ``w`` (hash), ``num``, ``at``, ``single``: the windows of one stretch of each kind."""
    wanted = kinds.groupBy(F.col("rep.key").alias("_key"), F.shiftright("rep.place", 48).alias("_tag")).agg(
        F.collect_list(F.struct("h", "num", "single", F.col("rep.place").alias("place"))).alias("seeds")
    )
    rows = _packed(docs).dropDuplicates(["_key", "_tag"]).join(wanted, ["_key", "_tag"]).select("_packed", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in _unpacked_slices(batches):
            texts = Texts(column, window)
            seeds = part.column("seeds")
            row = np.repeat(np.arange(len(seeds)), np.asarray(seeds.value_lengths()))
            flat = seeds.flatten()
            h, num, single, place = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "num", "single", "place"))
            number, first = (place >> 32) & 0xFF, place & _FIRST
            which = np.repeat(np.arange(len(place)), number)
            at = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            start = texts.rows[row[which]] + first[which] + at
            w = texts.run(start, start + window)
            yield pa.RecordBatch.from_arrays(
                [_long(h[which]), _long(w), _long(num[which]), pa.array(at.astype(np.int32)), pa.array(single[which])],
                ["h", "w", "num", "at", "single"],
            )

    return rows.mapInArrow(run, "h long, w long, num long, at int, single boolean")


def _hot_anchors(often: DataFrame) -> list[int]:
    """Anchors with a large part of all repeated stretches; at most ``HOT_PARTS`` of them."""
    total = often.agg(F.sum("c")).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_PARTS))
    return [r.h for r in often.where(F.col("c") >= least).select("h").collect()]


def _salted_join(big: DataFrame, other: DataFrame, on: list[str], hot: list[int], salt: Column) -> DataFrame:
    """Inner join with ``other``, which has one row for each ``on``; rows of hot anchors are dealt to
    ``SALTS`` tasks by ``salt``, and their partner goes to each of these."""
    if not hot:
        return big.join(other, on)
    is_hot = F.col("h").isin(hot)
    dealt = big.withColumn("_salt", F.when(is_hot, F.pmod(salt, F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(other.withColumn("_salt", F.explode(every)), [*on, "_salt"]).drop("_salt")


def repeated_stretches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_key``, ``_tag``, ``spans``: (first window, mask of the repeated ones among the next) of each
    document with a repeat.  Runs jobs: live seeds, kinds of stretches and their windows are stored.
    """
    if not 1 <= window <= 60:
        raise ValueError("A window has 1 to 60 words")
    seeds = _seeds(docs, window)
    often = store(seeds.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    hot = _hot_anchors(often)
    by_place, by_kind = F.xxhash64("key", "place"), F.xxhash64("num")
    live = store(_salted_join(seeds, often.select("h"), ["h"], hot, by_place), "seeds")
    kinds = live.groupBy("h", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("key", "place")).alias("rep"))
    kinds = store(kinds.withColumn("num", F.monotonically_increasing_id()), "stretches")
    several = kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    # A stretch that occurs once matches other kinds in part at most.
    parts = _salted_join(kinds, several, ["h"], hot, by_kind).withColumn("single", F.col("c") == 1)
    windows = store(_grown(docs, parts, window), "stretch-windows")
    shared = windows.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "w")
    masks = (
        _salted_join(windows.where("single"), shared, ["h", "w"], hot, by_kind)
        .groupBy("num")
        .agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))
    )
    partly = kinds.join(masks, "num").select("rep.key", "rep.place", "mask")
    given = kinds.where("c > 1").select("h", "stretch")
    whole = _salted_join(live, given, ["h", "stretch"], hot, by_place)
    whole = whole.select("key", "place", F.expr("shiftleft(1L, int(shiftright(place, 32) & 255)) - 1").alias("mask"))
    spans = whole.unionByName(partly).select(
        F.col("key").alias("_key"),
        F.shiftright("place", 48).alias("_tag"),
        F.struct(F.col("place").bitwiseAND(F.lit(_FIRST)).alias("first"), "mask").alias("span"),
    )
    return spans.groupBy("_key", "_tag").agg(F.collect_set("span").alias("spans"))


def _covered(n_words: int, first: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which words repeated windows cover."""
    bits = np.arange(64, dtype=np.uint64)
    set_bits = (mask.view(np.uint64)[:, None] >> bits) & np.uint64(1)
    which, at = np.nonzero(set_bits)
    change = np.zeros(n_words + 1, dtype=np.int64)
    start = first[which] + at
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_words``, ``n_removed``, ``kept_text``
    (the kept words, one space between) and ``removed`` (start, end) of maximal repeats in words."""
    spans = store(repeated_stretches(docs, window), "repeats")
    rows = _packed(docs).join(spans, ["_key", "_tag"], "left").select("_id", "_packed", "spans")
    schema = rows.select(
        F.col("_id").alias("doc_id"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit("").alias("kept_text"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("removed"),
    ).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_packed", max_rows=256, max_bytes=1 << 20):
                total, gone, kept, removed = [], [], [], []
                flat = part.column("spans").flatten()
                first, mask = flat.field("first").to_numpy(), flat.field("mask").to_numpy()
                sizes = part.column("spans").value_lengths().fill_null(0).to_pylist()
                at = 0
                for packed, size in zip(part.column("_packed").to_pylist(), sizes):
                    words = _unpack(packed).split()  # bytes are split at the same six separators
                    covered = _covered(len(words), first[at : at + size], mask[at : at + size], window)
                    at += size
                    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
                    removed.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                    total.append(len(words))
                    gone.append(int(covered.sum()))
                    keep = [0, *edges, len(words)]
                    left = [w for a, b in zip(keep[::2], keep[1::2]) for w in words[a:b]]
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(total, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(removed, kind),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
                )

    return rows.mapInArrow(run, schema)
