"""Line dedup: lines within one word edit of an earlier line, by a deletion-neighbourhood join.

Lines are compared as words (A-Z in lower case); an edit inserts, deletes or replaces one word.
Lines of fewer than ``min_words`` words have no variants: one edit is too much of them.  Equal ones
are compared from ``min_chars`` characters on, where that is given.  A line is
removed if an earlier line, by (document id, line number), is within the bound; the earliest
stays.

:func:`line_report` removes every late line, whatever its share of the document (a caller may
name a ``max_loss`` above which documents are left whole).  So does :func:`dedup_lines`, but it leaves a
document whole if the near-duplicate stage is to drop it: one that would lose more than
``max_loss`` of its words, all to one other document that loses nothing itself and whose
shingles are similar enough.

1. Lines and their halves are hashed in one pass, and equal lines become one, with its first place.
2. Two lines within one edit share the first or the last half of the shorter one.  Lines that
   share no half with another line cannot have a partner; the others go on.
3. Each of those emits its variants: itself, and itself without one word, for the words of the
   half that is not shared, as (hash, number of the word left out).
4. Equal variants join.  Lines that agree without their i-th word differ in that word only; a
   line that equals another one without some word is one deletion away.  Either way the
   earliest of a group is within the bound of all others, so each line meets one earliest
   partner and no group is spread into pairs.
5. Each line's earliest partner is verified on the words themselves.

Equal lines are joined by 64-bit hashes of their words.  Null or empty text: no lines to
compare, text unchanged.  Null id: later than all others.  Rows repeated in id and text are one
document given twice: both lose the same lines.  Other columns pass through, whatever
their names; ``n_chars`` follows the text where it is there.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm import near_dup
from sectorscope.llm.common import content_key, quoted, with_keys
from sectorscope.llm.hashing import LOWER, _place_values, column_bytes, mix, row_slices, word_hashes, word_spans
from sectorscope.sources.paths import store

MIN_WORDS = 6
# Shorter lines of few words, such as braces and bullets, are left alone.
MIN_CHARS = 4
MAX_LOSS = 0.5
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
PREFIX, SUFFIX = 1, 2


class Lines:
    """The lines with words in a column of texts, and hashes of their parts."""

    def __init__(self, column: pa.Array):
        data, bounds = column_bytes(column)
        starts, ends, rows = word_spans(data, bounds)
        self.words = word_hashes(data, starts, ends, lower=True)
        breaks = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(len(column)), np.diff(rows))
        number = np.searchsorted(breaks, starts)
        line = number + row  # grows with every line and every row
        first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
        self.first, self.last = first, np.append(first[1:], len(line)).astype(np.int64) if len(first) else first
        self.size = self.last - self.first
        self.row = row[first]
        self.number = number[first] - np.searchsorted(breaks, bounds[:-1])[self.row]
        self.n_lines = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1]) + 1
        place = np.arange(len(line)) - np.repeat(self.first, self.size)
        back = np.repeat(self.last, self.size) - 1 - np.arange(len(line))
        with np.errstate(over="ignore"):
            self.ahead = self._sums(self.words * _place_values(place))
            self.behind = self._sums(self.words * _place_values(back))
            self.moved = self._sums(self.words * _place_values(np.maximum(place - 1, 0)))
        self._spans = data, starts, ends

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.ahead[self.last] - self.ahead[self.first] + self.size.astype(np.uint64) * _LENGTH)

    def chars(self) -> np.ndarray:
        """Characters from the first word to the last."""
        data, starts, ends = self._spans
        before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        return before[ends[self.last - 1]] - before[starts[self.first]]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, key and side for the halves that a partner of the same, one more or one less
        word must share: of a shorter line of t words, t // 2 words."""
        lines, keys, sides = [], [], []
        each = np.arange(len(self.size))
        for length in (self.size, self.size - 1):
            half = length // 2
            chosen = each if length is self.size else each[half != self.size // 2]
            h = half[chosen]
            with np.errstate(over="ignore"):
                front = self.ahead[self.first[chosen] + h] - self.ahead[self.first[chosen]]
                rear = self.behind[self.last[chosen]] - self.behind[self.last[chosen] - h]
                for side, value in ((PREFIX, front), (SUFFIX, rear)):
                    lines.append(chosen)
                    keys.append(mix(value + h.astype(np.uint64) * _LENGTH + np.uint64(side)))
                    sides.append(np.full(len(chosen), side, dtype=np.int32))
        return np.concatenate(lines), np.concatenate(keys), np.concatenate(sides)

    def variants(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, hash without a word, number of that word.  A line that shares only a first half
        differs behind it, and one that shares only a last half before it."""
        half = np.maximum(self.size // 2 - 1, 0)
        low = np.where(sides == PREFIX, half, 0)
        high = np.where(sides == SUFFIX, self.size - half, self.size)
        count = high - low
        line = np.repeat(np.arange(len(self.size)), count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = self.first[line] + place
        with np.errstate(over="ignore"):
            value = self.ahead[at] - self.ahead[self.first[line]]
            value = value + self.moved[self.last[line]] - self.moved[at + 1]
            value = mix(value + (self.size[line] - 1).astype(np.uint64) * _LENGTH)
        return line, value, place


def within_one_edit(a: list, b: list) -> bool:
    """One inserted, deleted or replaced element at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    rest = same + 1 if len(a) == len(b) else same
    return a[rest:] == b[same + 1 :]


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=2)


def _pack(text: bytes | None) -> bytes | None:
    if text is None:
        return None
    return len(text).to_bytes(8, "little") + (_codec().compress(text, asbytes=True) if text else b"")


def _unpack(packed: bytes | None) -> str | None:
    if packed is None:
        return None
    size = int.from_bytes(packed[:8], "little")
    return _codec().decompress(packed[8:], size, asbytes=True).decode() if size else ""


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_slices(batch, column, max_bytes=1 << 20 if column == "_packed" else 4 << 20)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("_id"), content_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("text").alias("_text")
    )


def _long(array: np.ndarray) -> pa.Array:
    return pa.array(array.view(np.int64) if array.dtype == np.uint64 else array.astype(np.int64))


def _line_places(docs: DataFrame, min_words: int, min_chars: int | None = None) -> DataFrame:
    """``_id``, ``_key``, ``line``, ``n``, ``h`` of every line that is compared, ``total`` (words of its text),
    ``halves``: keys of a first and a last half in turn, none of lines of fewer than ``min_words``."""
    names = ["line", "n", "h", "total"]
    keyed = _keyed(docs)
    columns = [F.lit(0).cast("long").alias(c) for c in names]
    schema = keyed.select("_id", "_key", *columns, F.array(F.lit(0).cast("long")).alias("halves")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, "_text"):
            lines = Lines(rows.column("_text"))
            compared = lines.size >= min_words
            if min_chars is not None:
                compared |= lines.chars() >= min_chars
            long = np.flatnonzero(compared)
            row = pa.array(lines.row[long])
            columns = [rows.column("_id").take(row), rows.column("_key").take(row)]
            total = np.bincount(lines.row, weights=lines.size, minlength=rows.num_rows)[lines.row]
            columns += [_long(x[long]) for x in (lines.number, lines.size, lines.hashes(), total)]
            line, key, _ = lines.halves()
            # By line; within one a stable sort keeps first and last halves in turn.
            order = np.argsort(line, kind="stable")
            order = order[lines.size[line[order]] >= min_words]
            bounds = np.zeros(len(long) + 1, dtype=np.int32)
            bounds[1:] = np.cumsum(np.bincount(line[order], minlength=len(lines.size))[long])
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), _long(key[order])))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", *names, "halves"])

    return keyed.mapInArrow(run, schema)


def _line_halves(places: DataFrame) -> DataFrame:
    """``key``, ``side``, ``h``: the halves of every line."""
    halves = places.select("h", F.posexplode("halves").alias("place", "key"))
    return halves.select("key", F.when(F.col("place") % 2 == 0, PREFIX).otherwise(SUFFIX).alias("side"), "h")


def _order() -> Column:
    """Sorts documents by id, those without one last, and then by what they hold."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"), "line")


def _candidate_lines(docs: DataFrame, places: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines that share a half with another line: ``h``, ``sides``, ``first``, ``words`` (text),
    numbered in order of their first places."""
    halves = _line_halves(places)
    shared = (
        halves.groupBy("key", "side").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    ).select("key", "side")
    sides = (
        halves.join(shared, ["key", "side"])
        .groupBy("h")
        .agg(F.expr("bit_or(side)").alias("sides"))
    )
    wanted = heads.join(sides, "h").select(
        F.col("first.id").alias("_id"),
        F.col("first.key").alias("_key"),
        F.struct(F.col("first.line").alias("line"), "h", "sides").alias("l"),
    )
    wanted = wanted.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("l")).alias("lines"))
    texts = _packed_texts(docs).dropDuplicates(["_id", "_key"]).alias("t")
    wanted = wanted.alias("w")
    same = (F.col("t._key") == F.col("w._key")) & F.col("t._id").eqNullSafe(F.col("w._id"))
    rows = texts.join(wanted, same).select("w._id", "w._key", "t._packed", "w.lines")
    schema = rows.select(
        "_id", "_key", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("h"),
        F.lit(0).alias("sides"), F.lit("").alias("words"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "_packed"):
            row, number, h, sides, words = [], [], [], [], []
            for k, (packed, chosen) in enumerate(
                zip(part.column("_packed").to_pylist(), part.column("lines").to_pylist())
            ):
                lines = _unpack(packed).split("\n")
                for x in chosen:
                    row.append(k)
                    number.append(x["line"])
                    h.append(x["h"])
                    sides.append(x["sides"])
                    words.append(lines[x["line"]])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id").take(at),
                    part.column("_key").take(at),
                    pa.array(number, pa.int64()),
                    pa.array(h, pa.int64()),
                    pa.array(sides, pa.int32()),
                    pa.array(words, pa.string()),
                ],
                ["_id", "_key", "line", "h", "sides", "words"],
            )

    found = rows.mapInArrow(run, schema).select("h", "sides", _order().alias("first"), "words")
    # Range partitions in order: the row numbers grow with the order.
    return store(found.orderBy("first").withColumn("num", F.monotonically_increasing_id()), "lines")


def _variants(candidates: DataFrame) -> DataFrame:
    """``v``, ``place`` (-1: the whole line), ``num``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, "words"):
            lines = Lines(rows.column("words"))  # one line in each row
            num = rows.column("num").to_numpy()
            sides = rows.column("sides").to_numpy()
            line, value, place = lines.variants(sides)
            v = np.concatenate([lines.hashes(), value])
            which = np.concatenate([num, num[line]])
            at = np.concatenate([np.full(len(num), -1), place]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_long(v), pa.array(at), _long(which)], ["v", "place", "num"])

    return candidates.select("num", "sides", "words").mapInArrow(run, "v long, place int, num long")


def _earliest_partners(candidates: DataFrame) -> DataFrame:
    """(``num``, ``partner``): the earliest earlier line within one edit."""
    variants = _variants(candidates)
    least = variants.groupBy("v", "place").agg(F.min("num").alias("least"), F.count("*").alias("c"))
    least = store(least, "variants")
    replaced = least.where("place >= 0 AND c > 1").select("v", "place", F.col("least").alias("partner"))
    whole = least.where("place < 0").select("v", F.col("least").alias("whole"))
    shorter = least.where("place >= 0").groupBy("v").agg(F.min("least").alias("shorter"))
    deleted = shorter.join(whole, "v")
    # A variant meets the earliest line of its group, and lines one word apart each other.
    found = variants.join(replaced, ["v", "place"]).select("num", "partner")
    near = variants.join(deleted, "v").select(
        "num", F.when(F.col("place") < 0, F.col("shorter")).otherwise(F.col("whole")).alias("partner")
    )
    pairs = found.unionByName(near).where(F.col("partner") < F.col("num"))
    return pairs.groupBy("num").agg(F.min("partner").alias("partner"))


def _verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(``h``, ``first`` of its partner) where the words are within one edit."""
    own = candidates.select("num", "h", F.col("words").alias("own"))
    other = candidates.select(F.col("num").alias("partner"), F.col("words").alias("other"), "first")
    rows = pairs.join(own, "num").join(other, "partner").select("h", "first", "own", "other")
    schema = rows.select("h", "first").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                within_one_edit(_words(a), _words(b))
                for a, b in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist())
            ]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("h"), kept.column("first")], ["h", "first"])

    return rows.mapInArrow(run, schema)


def _words(line: str) -> list[bytes]:
    raw = LOWER[np.frombuffer(line.encode(), dtype=np.uint8)].tobytes()
    return raw.split()  # bytes are split at the same six separators


def _packed_texts(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs).where(F.col("_text").isNotNull())
    schema = keyed.select("_id", "_key", F.lit(b"").alias("_packed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, "_text"):
            packed = [_pack(t) for t in rows.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_key"), pa.array(packed, pa.binary())], ["_id", "_key", "_packed"]
            )

    return keyed.mapInArrow(run, schema)


def _late_lines(docs: DataFrame, min_words: int, min_chars: int | None = None) -> DataFrame:
    """The places of the lines that have an earlier partner, with its place as ``floor``.

    Runs jobs: the places of all lines and the candidate lines are stored.
    """
    if min_words < 4:
        raise ValueError("Lines of fewer than 4 words have no halves to share")
    places = store(_line_places(docs, min_words, min_chars), "line-places")
    heads = places.groupBy("h").agg(F.min(_order()).alias("first"), F.count("*").alias("c"))
    candidates = _candidate_lines(docs, places, heads)
    partners = _verified(_earliest_partners(candidates), candidates)
    repeated = heads.where("c > 1").select("h", "first")
    floor = repeated.unionByName(partners).groupBy("h").agg(F.min("first").alias("floor"))
    return places.drop("halves").join(floor, "h").where(_order() > F.col("floor"))


def _lines() -> Column:
    return F.collect_set(F.struct("line", "n")).alias("lines")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """``_id``, ``_key``, ``lines`` (numbers, and words of each): what each document would lose."""
    return _late_lines(docs, min_words, min_chars).groupBy("_id", "_key").agg(_lines())


def _lost_but_by_copies(
    docs: DataFrame, min_words: int, min_chars: int | None, max_loss: float, percent: int
) -> DataFrame:
    """:func:`removed_lines` without the documents that the near-duplicate stage is to drop whole."""
    late = _late_lines(docs, min_words, min_chars)
    owner = F.struct("floor.none", "floor.id", "floor.key")
    lost = late.groupBy("_id", "_key").agg(
        _lines(),
        F.countDistinct("line").alias("_c"),
        F.sum("n").alias("_n"),
        F.count("*").alias("_given"),
        F.max("total").alias("_total"),
        F.min(owner).alias("_low"),
        F.max(owner).alias("_high"),
    )
    lost = store(lost, "lost-lines")
    # Rows given k times have each line k times.
    share = F.col("_n") * F.col("_c") > F.lit(max_loss) * F.col("_total") * F.col("_given")
    one = F.col("_low").eqNullSafe(F.col("_high")) & (F.col("_low.key") != F.col("_key"))
    pairs = lost.where(share & one).select(F.col("_low.key").alias("a"), F.col("_key").alias("b"))
    pairs = store(pairs.join(lost.select(F.col("_key").alias("a")), "a", "left_anti"), "copies")
    wanted = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    texts = with_keys(_packed_texts(docs), wanted, "_key").groupBy("_key").agg(F.first("_packed").alias("packed"))
    copies = near_dup.confirmed(pairs, texts.withColumnRenamed("_key", "v"), percent)
    return lost.join(copies.select(F.col("b").alias("_key")), "_key", "left_anti").select("_id", "_key", "lines")


def _rebuilt(docs: DataFrame, lost: DataFrame, max_loss: float = 1.0) -> DataFrame:
    """``_row`` (all columns of ``docs`` but text), ``_id``, ``_text`` (new), ``_n_lines``, ``_n_removed``."""
    other = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*other).alias("_row"),
        F.col("doc_id").alias("_id"),
        content_key(F.col("doc_id"), F.col("text")).alias("_key"),
        F.col("text").alias("_text"),
    )
    lost = store(lost, "removed-lines")

    packed_schema = rows.select("_row", "_id", "_key", F.lit(b"").alias("_packed")).schema
    packed_schema["_packed"].nullable = True

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "_text"):
            packed = [_pack(t) for t in part.column("_text").cast(pa.binary()).to_pylist()]
            columns = [part.column(c) for c in ("_row", "_id", "_key")] + [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_id", "_key", "_packed"])

    left, right = rows.mapInArrow(pack, packed_schema).alias("d"), lost.alias("l")
    same = (F.col("d._key") == F.col("l._key")) & F.col("d._id").eqNullSafe(F.col("l._id"))
    joined = left.join(right, same, "left").select("d._row", "d._id", "d._packed", "l.lines")
    schema = joined.select(
        "_row", "_id", F.lit("").alias("_text"), *[F.lit(0).cast("long").alias(c) for c in ("_n_lines", "_n_removed")]
    ).schema
    schema["_text"].nullable = True

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "_packed"):
            texts, counts, gone = [], [], []
            for packed, chosen in zip(part.column("_packed").to_pylist(), part.column("lines").to_pylist()):
                text = _unpack(packed)
                lines = text.split("\n") if text is not None else []
                removed = 0
                if chosen:
                    total = len(text.encode().split())
                    if sum(x["n"] for x in chosen) <= max_loss * total:
                        drop = {x["line"] for x in chosen}
                        removed = len(drop)
                        text = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                texts.append(text)
                counts.append(len(lines))
                gone.append(removed)
            columns = [part.column("_row"), part.column("_id"), pa.array(texts, pa.string())]
            columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_id", "_text", "_n_lines", "_n_removed"])

    return joined.mapInArrow(rebuild, schema)


def line_report(
    docs: DataFrame, min_words: int = MIN_WORDS, max_loss: float = 1.0, min_chars: int | None = MIN_CHARS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_lines``, ``n_removed``, ``kept_text``."""
    docs = docs.select("doc_id", "text")
    rebuilt = _rebuilt(docs, removed_lines(docs, min_words, min_chars), max_loss)
    return rebuilt.select(
        F.col("_id").alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_text").alias("kept_text"),
    )


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_loss: float = MAX_LOSS,
    percent: int = 75,
    min_chars: int | None = MIN_CHARS,
) -> DataFrame:
    """``docs`` with every late line removed from ``text`` but in documents that the near-duplicate
    stage drops at ``percent``; ``n_chars`` follows the text."""
    rebuilt = _rebuilt(docs, _lost_but_by_copies(docs, min_words, min_chars, max_loss, percent))
    columns = []
    for field in docs.schema:
        if field.name == "text":
            columns.append(F.col("_text").alias("text"))
        elif field.name == "n_chars":
            size = F.char_length("_text").cast(field.dataType)
            old = F.col("_row")["n_chars"]
            columns.append(F.when(F.col("_n_removed") > 0, size).otherwise(old).alias("n_chars"))
        else:
            columns.append(F.col("_row")[field.name].alias(field.name))
    return rebuilt.select(*columns)
