"""Words of Arrow string columns as 64-bit hashes, with numpy and without Python strings.

A word's hash is the sum of random table values of its bytes times random values of their
places, mixed; runs of words are hashed the same way from their words.  All tables follow
from a fixed seed, so every task and every run gives the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
PLACES = 4096

_random = np.random.default_rng(0x5EED)
# Bytes 0x20 and 0x09-0x0D separate words.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[SEPARATOR] = 0
PLACE_VALUE = _random.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _place_values(places: np.ndarray) -> np.ndarray:
    if len(places) and int(places.max()) >= PLACES:
        far = mix(places.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.where(places < PLACES, PLACE_VALUE[places % PLACES], far)
    return PLACE_VALUE[places]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 bounds of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 bounds of the rows among them."""
    inside = ~SEPARATOR[data]
    row_start = np.zeros(len(data) + 1, dtype=bool)
    row_start[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | row_start[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | row_start[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word, in blocks of about ``BLOCK_BYTES``."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(starts, starts[first] + BLOCK_BYTES, side="right"))
        last = max(last, first + 1)
        a, b = int(starts[first]), int(ends[last - 1])
        part = data[a:b]
        if lower:
            part = LOWER[part]
        begin = starts[first:last] - a
        places = np.arange(b - a) - np.repeat(begin, np.diff(np.append(begin, b - a)))
        with np.errstate(over="ignore"):
            value = BYTE_VALUE[part] * _place_values(places)
            out[first:last] = np.add.reduceat(value, begin)
        first = last
    return mix(out)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words (bounds between rows are not minded)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(length), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            total += words[k : k + n] * WORD_VALUE[k % 256]
    return mix(total)


def set_of_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; all its words as one where there are fewer."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(run_hashes(words, min(size, len(words))))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The set of each row's text, with A-Z in lower case."""
    data, bounds = column_bytes(column)
    starts, ends, rows = word_spans(data, bounds)
    words = word_hashes(data, starts, ends, lower=True)
    return [set_of_shingles(words[a:b], size) for a, b in zip(rows, rows[1:])]


def row_slices(
    batch: pa.RecordBatch, column: str, max_rows: int = 512, max_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a few rows and of texts of a few megabytes, or of one longer text."""
    bounds = column_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + max_rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
