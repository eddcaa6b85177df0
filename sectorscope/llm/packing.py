"""Packing of tokenized documents into sequences of bounded length.

Every text is encoded (``tokens``), an end id is added, and a document longer than a sequence
is cut into full pieces, the first of which may be shorter.  Full pieces are sequences of
their own; the others are packed.

Packing works on lengths alone, on narrow rows in the shared folder, dealt evenly over tasks.
A task packs blocks of a fixed number of pieces: best fit, longest first, then a local search
over the bins that are not full.  Each of them in turn exchanges its pieces with those of any
other, fuller or not: one for one, two for one, one for two (all pairs of a bin), or moves them,
always with the largest gain in the sum of squared fills, so that it ends; a bin that becomes
empty is a sequence saved.  The search stops at a number of bins that no packing is below, or
once it has tried every bin without a gain; nothing else bounds it.  What is left loose at the end of a block goes into a further round with the loose
bins of the other blocks, until they make up one block.  A block is bounded by its number
of pieces, whatever the size of the table, and no key decides which pieces share a block.

Null text counts as empty and gives one piece that holds the end id.  A very long text is encoded
in overlapping chunks and may give any number of pieces; equal lengths are packed in any order.  Rows are handled one by
one, so repeated ids and texts are packed each.  Extra columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.tokens import encoded_slices
from sectorscope.sources.paths import store

BLOCK_PIECES = 16_384
# Texts over this many characters are encoded in overlapping chunks.
CHUNK_CHARS = 1 << 20
# Bins at least this full are final; looser ones get another round.
CLOSED_SHARE = 0.98


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` for every piece; no shuffle."""
    schema = docs.select(
        "doc_id",
        F.lit(0).cast("int").alias("piece"),
        *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")],
    ).schema
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, encoded in encoded_slices(batches, tokenizer_path, CHUNK_CHARS):
            row, number, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoded):
                ids += end
                total = len(ids) // 4
                at, size = 0, (total - 1) % capacity + 1
                for piece in range(-(-total // capacity)):
                    row.append(k)
                    number.append(piece)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(number, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a bin with room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            same = by_room[room]
            b = same.pop()
            if not same:
                rooms &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing is below: for each size ``t``, pieces over ``capacity - t`` stand
    alone, those over half share no bin, and what is left of their room takes pieces from ``t`` on."""
    sizes = np.sort(np.asarray(lengths, dtype=np.int64))
    if not len(sizes):
        return 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    t = np.unique(np.concatenate([[0], sizes[sizes <= capacity // 2]]))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    alone = np.searchsorted(sizes, capacity - t, side="right")
    small = total[half] - total[np.searchsorted(sizes, t, side="left")]
    room = (alone - half) * capacity - (total[alone] - total[half])
    return int((len(sizes) - half + np.maximum(0, -(-(small - room) // capacity))).max())


class _Search:
    """Exchanges between any bin that is not full and all others, as long as the sum of squared fills grows."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
        self.home = np.empty(len(lengths), dtype=np.int64)
        for number, members in enumerate(bins):
            self.home[members] = number
        self._pairs_of_all()

    def _pairs_of(self, b: int) -> np.ndarray:
        """All pairs of a bin's pieces, a row each."""
        members = np.array(self.bins[b], dtype=np.int64)
        return np.stack([members[k] for k in np.triu_indices(len(members), 1)], axis=1)

    def _pairs_of_all(self) -> None:
        loose = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist()
        found = [self._pairs_of(b) for b in loose]
        self.pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        self.listed = len(self.pairs)

    def _apply(self, source: int, target: int, out: list[int], back: list[int]) -> None:
        for k in out:
            self.bins[source].remove(k)
            self.bins[target].append(k)
        for k in back:
            self.bins[target].remove(k)
            self.bins[source].append(k)
        self.home[out], self.home[back] = target, source
        gain = int(self.lengths[out].sum() - self.lengths[back].sum())
        self.fill[source] -= gain
        self.fill[target] += gain
        # Pairs that no longer share a bin are passed over until the list has doubled.
        self.pairs = np.concatenate([self.pairs, self._pairs_of(source), self._pairs_of(target)])
        if len(self.pairs) > 2 * self.listed + 1024:
            self._pairs_of_all()

    def _best(self, source: int, sizes: np.ndarray, back: np.ndarray, home: np.ndarray) -> tuple[int, int, int]:
        """Gain, place in the sorted ``sizes`` that leave, and place in ``back`` of the best exchange.

        The gain grows with what the target wins, so each target takes the largest size that fits.
        """
        if not len(sizes) or not len(back):
            return 0, 0, 0
        fill = self.fill[home]
        place = np.searchsorted(sizes, back + self.capacity - fill, side="right") - 1
        won = sizes[place] - back
        ok = (place >= 0) & (won > 0) & (home != source) & (fill > 0)
        gain = np.where(ok, won * (fill - self.fill[source] + won), 0)
        j = int(gain.argmax())
        return int(gain[j]), int(place[j]), j

    def _step(self, source: int) -> bool:
        """The exchange that raises the sum of squared fills by most; False if none does."""
        own = self.bins[source]
        singles = np.array(sorted(own, key=lambda k: self.lengths[k]), dtype=np.int64)
        doubles = self._pairs_of(source)
        sums = self.lengths[doubles].sum(axis=1)
        doubles, sums = doubles[order := np.argsort(sums, kind="stable")], sums[order]
        bins = np.arange(len(self.bins))
        same = self.home[self.pairs[:, 0]] == self.home[self.pairs[:, 1]]
        pairs = self.pairs[same]
        one = self.lengths[singles]
        kinds = [
            (singles[:, None], one, np.zeros((len(bins), 0), np.int64), np.zeros(len(bins), np.int64), bins),  # move
            (singles[:, None], one, np.arange(len(self.home))[:, None], self.lengths, self.home),  # one for one
            (doubles, sums, np.arange(len(self.home))[:, None], self.lengths, self.home),  # two for one
            (singles[:, None], one, pairs, self.lengths[pairs].sum(axis=1), self.home[pairs[:, 0]]),  # one for two
        ]
        best, move = 0, None
        for out, sizes, back, back_sizes, home in kinds:
            gain, i, j = self._best(source, sizes, back_sizes, home)
            if gain > best:
                best, move = gain, (int(home[j]), out[i].tolist(), back[j].tolist())
        if move is None:
            return False
        self._apply(source, *move)
        return True

    def run(self) -> list[list[int]]:
        """Ends at the least number of bins, or when no bin has an exchange left."""
        least = least_bins(self.lengths, self.capacity)
        changed = True
        while changed:
            changed = False
            for source in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[source] < self.capacity:
                    if np.count_nonzero(self.fill) <= least:
                        return [b for b in self.bins if b]
                    if not self._step(source):
                        break
                    changed = True
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions with at most ``capacity`` in each."""
    lengths = np.asarray(lengths, dtype=np.int64)
    return _Search(lengths, best_fit(lengths, capacity), capacity).run()


def _pack_round(rows: DataFrame, capacity: int, number: int, last: bool, block: int) -> DataFrame:
    fields = [f.name for f in rows.schema]
    schema = rows.select(
        "*",
        F.lit(0).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("_closed"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def blocks() -> Iterator[pa.Table]:
            held, n = [], 0
            for batch in batches:
                while batch.num_rows:
                    part = batch.slice(0, block - n)
                    held.append(part)
                    n, batch = n + part.num_rows, batch.slice(part.num_rows)
                    if n == block:
                        yield pa.Table.from_batches(held)
                        held, n = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for table in blocks():
            lengths = table.column("length").to_numpy()
            order, ids, offsets, closed = [], [], [], []
            for members in pack(lengths, capacity):
                fill = 0
                for k in members:
                    order.append(k)
                    ids.append(number << 56 | task << 28 | made)
                    offsets.append(fill)
                    fill += int(lengths[k])
                closed += [last or fill >= CLOSED_SHARE * capacity] * len(members)
                made += 1
            out = table.take(pa.array(order, pa.int64())).combine_chunks()
            columns = [out.column(c).combine_chunks() for c in fields]
            columns += [pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(closed, pa.bool_())]
            yield from pa.Table.from_arrays(columns, [*fields, "sequence_id", "offset", "_closed"]).to_batches()

    return rows.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    block: int = BLOCK_PIECES,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Runs jobs: one that encodes and stores the pieces, one for each round of packing.
    """
    cut = store(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    full = cut.where(F.col("length") == capacity).select(
        "*",
        F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    out, left, number = full, cut.where(F.col("length") < capacity), 1
    waiting = left.count()
    while waiting:
        tasks = -(-waiting // block)
        last = tasks == 1
        packed = store(_pack_round(left.repartition(tasks), capacity, number, last, block), "packed")
        out = out.unionByName(packed.where("_closed").drop("_closed"))
        if last:
            break
        left = packed.where("NOT _closed").drop("sequence_id", "offset", "_closed")
        before, waiting = waiting, left.count()
        number += 1
        if waiting > 0.8 * before:  # rounds no longer shrink: each block keeps what it has
            number += 1
            packed = store(_pack_round(left.repartition(tasks), capacity, number, True, block), "packed")
            out = out.unionByName(packed.drop("_closed"))
            break
    return out
