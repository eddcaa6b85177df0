"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles (words in lower-case A-Z; fewer words: all
of them as one).  Documents with equal sets form a class, and classes are linked when their
sets have a similarity of ``percent`` or more.

* A signature of ``WIDTH`` minwise tokens stands for the set: each is the least token under its
  own hash, and two sets agree on it with a probability equal to their similarity.
* ``trees`` independent trees branch all classes: a node picks ``BRANCHES`` minwise tokens, the
  same for all its classes, and a class goes to the child of each of its chosen tokens.  With
  two branches a linked pair stays together to any depth of a tree with a probability of at
  least 8/9 (at 0.75), so the six trees miss less than one pair in 10^5, near the limit only.
* A node of up to ``SMALL`` classes is compared exhaustively.  A larger one is compared with its
  first class.  Where few are similar to it (documents that share a passage), the node branches
  on, down to ``DEPTH`` levels; where many are (a group of near copies) and at the last level it
  stays as it is, since branching hardly divides it.
* Compared means: sizes and signatures allow the similarity (the signature test drops a pair
  at the limit once in 5 * 10^5).  Links are confirmed on the full sets, of the texts, in two
  rounds: first one link for each class, then all other candidates whose classes the first
  round has not connected.  Large nodes come last: every class outside the node's main component
  is compared with all others on the full sets, block by block inside tasks, and only the links
  that connect something new leave a task.  So no pair of a large group has to be listed, and
  none is left out.

Null, empty or blank text: empty set, linked with nothing.  Null id: takes part; it is never the
id of a component, and a component without ids has a null one.  Repeated rows are in one class.
The verdicts of :func:`near_duplicates` go by id, so all rows with the component's id are kept;
:func:`keep_first` keeps exactly one row of each component.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import content_key, quoted, with_keys
from sectorscope.llm.components import components
from sectorscope.llm.hashing import mix, row_slices, shingle_sets
from sectorscope.sources.paths import store

SHINGLE = 5
WIDTH = 64
TREES = 6
BRANCHES = 2
SMALL = 48
DEPTH = 3
# Least share of equal minwise tokens of a pair that is confirmed on the full sets.
LEAST_SHARE = 0.5
HUB_MEMBERS = 512
BLOCK = 4096
# From this share of classes similar to its first one on, a large node does not branch.
DENSE = 0.25

_random = np.random.default_rng(0xC0FFEE)
_FACTORS = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``WIDTH`` 32-bit minwise tokens for each non-empty set."""
    starts = np.cumsum([0, *[len(s) for s in sets]])[:-1]
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.empty((len(sets), WIDTH), dtype=np.int32)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            least = np.minimum.reduceat(tokens * _FACTORS[k] + _OFFSETS[k], starts)
            # The low bits follow from the high ones no better than chance after mixing.
            out[:, k] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sketches(docs: DataFrame, whole_rows: bool) -> DataFrame:
    """Per row: id, key, set size, 128-bit key of the set, signature, compressed text; with
    ``whole_rows`` all other columns (``_rest``) and whether the text is null (``_no_text``) as well."""
    given = [F.col("doc_id").alias("_id"), content_key(F.col("doc_id"), F.col("text")).alias("_key")]
    if whole_rows:
        other = [F.col(quoted(c)) for c in docs.columns if c != "text"]
        given += [F.struct(*other).alias("_rest"), F.col("text").isNull().alias("_no_text")]
    rows = docs.select(*given, "text")
    carried = rows.columns[:-1]
    out = rows.select(
        *carried,
        *[F.lit(0).cast("long").alias(c) for c in ("n", "k1", "k2")],
        F.array(F.lit(0)).alias("sig"),
        F.lit(b"").alias("packed"),
    ).schema

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text"):
                texts = rows.column("text")
                sets = shingle_sets(texts, SHINGLE)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bounds = np.zeros(len(sets) + 1, dtype=np.int32)
                bounds[1:] = np.cumsum(np.where(n > 0, WIDTH, 0))
                flat = np.zeros(0, np.int32)
                if full:
                    starts = np.cumsum([0, *[len(s) for s in full]])[:-1]
                    tokens = np.concatenate(full)
                    with np.errstate(over="ignore"):
                        k1[n > 0] = np.add.reduceat(mix(tokens ^ np.uint64(0xA5A5)), starts)
                    k2[n > 0] = np.bitwise_xor.reduceat(mix(tokens + np.uint64(0x1234567)), starts)
                    flat = signatures(full).reshape(-1)
                sig = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
                packed = [pack_text(t) for t in texts.cast(pa.binary()).to_pylist()]
                columns = [*(rows.column(c) for c in carried), pa.array(n)]
                columns += [pa.array(k.view(np.int64)) for k in (k1, k2)]
                columns += [sig, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "n", "k1", "k2", "sig", "packed"])
        pa.default_memory_pool().release_unused()  # the worker waits for further tasks

    return rows.mapInArrow(sketch, out)


def pack_text(text: bytes | None) -> bytes:
    """Length and compressed bytes."""
    text = text or b""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True) if text else b""


def unpack_text(packed: bytes) -> bytes:
    if not packed:
        return b""
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH)


def _allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smaller set is large enough for the similarity."""
    return np.minimum(n, m) * 100 >= percent * np.maximum(n, m)


EDGES = "a long, b long, share int"


def _edges(a: list, b: list, share: list) -> pa.RecordBatch:
    a, b, share = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, share))
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays(
        [pa.array(low), pa.array(high), pa.array(share.astype(np.int32))], ["a", "b", "share"]
    )


def _runs(column: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)])) if len(column) else []


def _node_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows again, cut so that rows with equal keys, which come together, stay so."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            first = [batch.column(k)[0] for k in keys]
            if held and [held[-1].column(k)[0] for k in keys] != first:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _small_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of each node that sizes and signatures allow; a node has ``SMALL`` rows at most."""
    least = int(np.ceil(LEAST_SHARE * WIDTH))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_batches(batches, ["path"]):
            table = table.combine_chunks()
            path = table.column("path").to_numpy()
            v, n = table.column("v").to_numpy(), table.column("n").to_numpy()
            sig = _signature_matrix(table.column("sig").combine_chunks())
            a, b, share = [], [], []
            for start, end in _runs(path):
                i, j = np.triu_indices(end - start, 1)
                i, j = i + start, j + start
                ok = _allowed(n[i], n[j], percent) & (v[i] != v[j])
                i, j = i[ok], j[ok]
                same = (sig[i] == sig[j]).sum(axis=1)
                ok = same >= least
                if ok.any():
                    a.append(v[i[ok]])
                    b.append(v[j[ok]])
                    share.append(same[ok])
            yield _edges(a, b, share)

    ordered = rows.select("path", "v", "n", "sig").repartition("path").sortWithinPartitions("path")
    return ordered.mapInArrow(compare, EDGES)


def _with_hub(rows: DataFrame, percent: int) -> DataFrame:
    """Each class of a large node against the node's first one: ``path``, ``a``, ``b``, ``share``, and
    whether they may be similar.

    The first class is sent once to each group of about ``SMALL`` classes, so that the classes of
    a node need no join with it and are spread over tasks.
    """
    least = int(np.ceil(LEAST_SHARE * WIDTH))
    groups = F.ceil(F.col("size") / F.lit(SMALL)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))
    given = ["path", "v", "n", "sig"]
    hubs = rows.where("v = hub").select(*given, every.alias("salt"), F.lit(0).alias("second"))
    members = rows.select(*given, F.pmod(F.xxhash64("v"), groups).alias("salt"), F.lit(1).alias("second"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last hub so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            path, salt, v, n, second = (batch.column(c).to_numpy() for c in ("path", "salt", "v", "n", "second"))
            at = np.maximum.accumulate(np.where(second == 0, np.arange(len(v)), 0))
            if second[0] or (path != path[at]).any() or (salt != salt[at]).any():
                raise ValueError("A class came before its hub")
            held = batch.slice(int(at[-1]), 1)
            own = np.flatnonzero(second)
            at = at[own]
            sig = _signature_matrix(batch.column("sig"))
            same = (sig[own] == sig[at]).sum(axis=1)
            ok = _allowed(n[own], n[at], percent) & (same >= least)
            edges = _edges([v[own]], [v[at]], [same])
            yield pa.RecordBatch.from_arrays(
                [pa.array(path[own]), *edges.columns, pa.array(ok)], ["path", "a", "b", "share", "similar"]
            )

    ordered = hubs.unionByName(members).repartition("path", "salt").sortWithinPartitions("path", "salt", "second")
    return ordered.mapInArrow(compare, f"path long, {EDGES}, similar boolean")


def _chosen(path: Column, sig: Column, branch: int) -> Column:
    """Path of the child that the branch's minwise token, the same for the whole node, leads to."""
    place = F.pmod(F.xxhash64(path, F.lit(branch)), F.lit(WIDTH)).cast("int")
    return F.xxhash64(path, F.lit(branch), F.get(sig, place))


def _first_level(classes: DataFrame, trees: int) -> DataFrame:
    """The roots' children; the roots use different minwise tokens."""
    children = [
        F.xxhash64(F.lit(tree), F.lit(branch), F.get(F.col("sig"), F.lit((tree * BRANCHES + branch) % WIDTH)))
        for tree in range(trees)
        for branch in range(BRANCHES)
    ]
    return classes.select("v", F.explode(F.array(*children)).alias("path"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Size and first class of nodes with two or more; one node of those with the same classes."""
    sizes = rows.groupBy("path").agg(
        F.count("*").alias("size"),
        F.min("v").alias("hub"),
        F.sum(F.xxhash64("v").bitwiseAND(F.lit((1 << 40) - 1))).alias("_sum"),
        F.bit_xor(F.xxhash64("v", F.lit(1))).alias("_xor"),
    )
    same = sizes.where(F.col("size") > 1).groupBy("size", "hub", "_sum", "_xor").agg(F.min("path").alias("path"))
    return same.select("path", "size", "hub")


def _candidates(classes: DataFrame, percent: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (``a``, ``b``, ``share``) and the nodes that stay large (``path``, ``v``, ``size``)."""
    level, found, whole = _first_level(classes, trees), [], []
    for depth in range(1, DEPTH + 1):
        members = level.join(store(_nodes(level), "nodes"), "path")
        if depth == 1:  # deeper levels carry their signatures along
            members = members.join(classes, "v")
        members = store(members, "members")
        found.append(_small_nodes(members.where(F.col("size") <= SMALL), percent))
        large = members.where(F.col("size") > SMALL)
        compared = store(_with_hub(large, percent), "hubs")
        found.append(compared.where("similar AND a <> b").select("a", "b", "share"))
        staying = large.select("path", "v", "size")
        if depth == DEPTH:
            whole.append(staying)
            break
        few = compared.groupBy("path").agg(F.avg(F.col("similar").cast("int")).alias("alike")).where(F.col("alike") < DENSE)
        few = store(few.select("path"), "branching-nodes")
        if few.isEmpty():
            whole.append(staying)
            break
        whole.append(store(staying.join(few, "path", "left_anti"), "whole"))
        branching = store(large.select("path", "v", "n", "sig").join(few, "path"), "branching")
        children = [_chosen(F.col("path"), F.col("sig"), k) for k in range(BRANCHES)]
        level = branching.select("v", "n", "sig", F.explode(F.array(*children)).alias("path"))
    pairs = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("share").alias("share"))
    return store(pairs, "pairs"), reduce(DataFrame.unionByName, whole)


class _Block:
    """Sets that others are compared with, by products of membership matrices."""

    COLUMNS = 1024

    def __init__(self, sets: list[np.ndarray], v: np.ndarray, label: np.ndarray):
        self.v, self.label = v, label
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.row = np.repeat(np.arange(len(sets)), self.size)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.tokens, self.token = np.unique(tokens, return_inverse=True)

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Size of the intersection of each of ``sets`` with each own set."""
        out = np.zeros((len(sets), len(self.size)), dtype=np.float32)
        if not len(self.tokens):
            return out
        theirs = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.tokens, theirs), len(self.tokens) - 1)
        hit = self.tokens[at] == theirs
        row, at = row[hit], at[hit]
        column = np.full(len(self.tokens), -1, dtype=np.int64)
        used = np.unique(at)
        column[used] = np.arange(len(used))
        own_column, their_column = column[self.token], column[at]
        for low in range(0, len(used), self.COLUMNS):
            width = min(self.COLUMNS, len(used) - low)
            a = np.zeros((len(sets), width), dtype=np.float32)
            b = np.zeros((len(self.size), width), dtype=np.float32)
            mine = (own_column >= low) & (own_column < low + width)
            other = (their_column >= low) & (their_column < low + width)
            a[row[other], their_column[other] - low] = 1
            b[self.row[mine], own_column[mine] - low] = 1
            out += a @ b.T
        return out


def _links_in_nodes(whole: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that connect classes of large nodes with different labels.

    Classes with a node's most frequent label wait in blocks of about ``BLOCK``; every other
    class waits in one block and visits all.  A task holds one block and streams its visitors.
    """
    rows = whole.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    counts = rows.groupBy("path", "label").agg(F.count("*").alias("c"))
    most = counts.groupBy("path").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("kinds"))
    mixed = most.where(F.col("kinds") > 1).select("path", F.col("m.label").alias("main"))
    rows = rows.join(mixed, "path")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("v"), blocks.cast("long")).cast("int")
    waits = F.array(F.struct(own.alias("block"), F.lit(0).alias("visits")))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("visits")))
    places = F.when(F.col("label") != F.col("main"), F.concat(waits, visits)).otherwise(waits)
    rows = rows.select("path", "v", "label", F.explode(places).alias("p"))
    rows = rows.select("path", "v", "label", "p.block", "p.visits").join(texts, "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, known = None, [], None, {}

        def find(x: int) -> int:
            while (up := known.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            for part in row_slices(batch, "packed", max_rows=256, max_bytes=1 << 20):
                column = pa.array([unpack_text(p) for p in part.column("packed").to_pylist()], pa.large_binary())
                sets = shingle_sets(column, SHINGLE)
                path, number, v, label, visits = (
                    part.column(c).to_numpy() for c in ("path", "block", "v", "label", "visits")
                )
                a, b = [], []
                for start, end in _runs(path ^ (number.astype(np.int64) << 1) ^ visits):
                    group = (path[start], number[start])
                    if group != now:
                        now, held, block, known = group, [], None, {}
                    if not visits[start]:
                        held += [(sets[k], v[k], label[k]) for k in range(start, end)]
                        continue
                    if block is None:
                        own_sets, own_v, own_label = zip(*held) if held else ((), (), ())
                        block, held = _Block(list(own_sets), np.array(own_v), np.array(own_label)), []
                    both = block.common(sets[start:end])
                    size = np.array([len(s) for s in sets[start:end]])[:, None] + block.size[None, :]
                    near = (both * 100 >= percent * (size - both)) & (label[start:end, None] != block.label[None, :])
                    for i, j in zip(*np.nonzero(near)):
                        x, y = find(int(label[start + i])), find(int(block.label[j]))
                        if x != y:
                            known[max(x, y)] = min(x, y)
                            a.append(min(int(v[start + i]), int(block.v[j])))
                            b.append(max(int(v[start + i]), int(block.v[j])))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = rows.select("path", "block", "visits", "v", "label", "packed")
    ordered = ordered.repartition("path", "block").sortWithinPartitions("path", "block", "visits")
    return ordered.mapInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough.

    A pair's first class is a hub; its text is sent once to each group of up to about
    ``HUB_MEMBERS`` partners, so a class with very many partners is spread over tasks.
    """
    degrees = pairs.groupBy("a").agg(F.count("*").alias("d"))
    groups = F.ceil(F.col("d") / F.lit(HUB_MEMBERS)).cast("long")
    hubs = degrees.select("a", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("salt"), F.col("a").alias("v"))
    partners = pairs.join(degrees, "a").select(
        "a", F.pmod(F.xxhash64("b"), groups).alias("salt"), F.col("b").alias("v")
    )
    wanted = hubs.withColumn("second", F.lit(0)).unionByName(partners.withColumn("second", F.lit(1)))
    rows = wanted.join(texts.select("v", "packed"), "v")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "second")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for part in row_slices(batch, "packed", max_bytes=1 << 20):
                texts = pa.array([unpack_text(p) for p in part.column("packed").to_pylist()], pa.large_binary())
                sets = shingle_sets(texts, SHINGLE)
                a, b = [], []
                for k, (first, salt, v, second) in enumerate(
                    zip(*(part.column(c).to_pylist() for c in ("a", "salt", "v", "second")))
                ):
                    if not second:
                        hub, own = (first, salt), sets[k]
                        continue
                    if hub != (first, salt):
                        raise ValueError("A partner came before its hub")
                    both = len(np.intersect1d(own, sets[k], assume_unique=True))
                    if both * 100 >= percent * (len(own) + len(sets[k]) - both):
                        a.append(first)
                        b.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("a", "salt", "v", "second", "packed").mapInArrow(check, "a long, b long")


def _with_more(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with further ones, and the labels that follow."""
    more = store(more, "more-links")
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    return links, components(links)


def _order() -> Column:
    """Sorts rows by id, those without one last, then by what they hold, then by number."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"), "_row")


def _labelled(
    docs: DataFrame, percent: int, trees: int, whole_rows: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The stored sketches, and the classes with their component's ``label``, least id (``first_id``)
    and first row (``first``).

    Runs jobs: sketches, levels of the trees, two rounds of confirmation, components.
    """
    rows = store(_sketches(docs, whole_rows).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    filled = rows.where(F.col("n") > 0)
    by_set = store(
        filled.groupBy("n", "k1", "k2").agg(
            F.min("_row").alias("v"), F.min("_id").alias("first_id"), F.min(_order()).alias("first")
        ),
        "classes",
    )
    classes = store(by_set.select(F.col("v").alias("_row")).join(filled, "_row").select(
        F.col("_row").alias("v"), "n", "sig"
    ), "signatures")
    pairs, whole = _candidates(classes, percent, trees)
    # The texts of all classes that are looked at again move once.
    involved = reduce(DataFrame.unionByName, [pairs.select(F.col(c).alias("v")) for c in ("a", "b")], whole.select("v"))
    texts = store(with_keys(filled.select(F.col("_row").alias("v"), "packed"), involved.distinct(), "v"), "texts")
    # First round: for each class one candidate, a sure one with the lowest number if it has any.
    sure = F.col("share") >= int(0.85 * WIDTH)
    choice = F.struct(
        sure.cast("int").alias("sure"), F.when(~sure, F.col("share")).otherwise(0).alias("share"), (-F.col("a")).alias("a")
    )
    first = pairs.groupBy("b").agg(F.max(choice).alias("c")).select((-F.col("c.a")).alias("a"), "b")
    first = store(first, "first-pairs")
    links = store(confirmed(first, texts, percent), "first-links")
    labels = components(links)

    def label(side: str) -> DataFrame:
        return labels.select(F.col("v").alias(side), F.col("label").alias(f"label_{side}"))

    rest = pairs.join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    rest = store(rest.where(apart).select("a", "b"), "second-pairs")
    links, labels = _with_more(links, labels, confirmed(rest, texts, percent))
    links, labels = _with_more(links, labels, _links_in_nodes(whole, labels, texts, percent))

    return rows, by_set.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = TREES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``, ``component_id`` (the
    least id that links reach), ``kept`` (it is its own), ``_id``, ``_key``.
    """
    rows, labelled = _labelled(docs, percent, trees)
    ids = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = labelled.join(ids, "label").select("n", "k1", "k2", "component_id")
    of_row = rows.select("_id", "_key", "n", "k1", "k2").join(of_set, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return of_row.select(
        F.col("_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
        "_id",
        "_key",
    )


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component, unchanged: the least by id, nulls last, and key.

    Rows without words are linked with nothing; of those that agree in id and text one stays.
    """
    rows, labelled = _labelled(docs, percent, TREES, whole_rows=True)
    first = labelled.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    blank = rows.where(F.col("n") == 0).groupBy("_id", "_key").agg(F.min("_row").alias("_row")).select("_row")
    # The stored rows hold compressed texts, so that these and no plain ones move.
    found = rows.select("_row", "_rest", "_no_text", "packed").join(first.unionByName(blank), "_row")
    found = found.select("_rest", "_no_text", "packed")
    schema = found.select("_rest", F.lit("").alias("_text")).schema
    schema["_text"].nullable = True

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "packed", max_bytes=1 << 20):
                held = zip(part.column("packed").to_pylist(), part.column("_no_text").to_pylist())
                texts = pa.array([None if none else unpack_text(p) for p, none in held], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_rest"), texts.view(pa.string())], ["_rest", "_text"])
        pa.default_memory_pool().release_unused()  # the worker waits for further tasks

    columns = [F.col("_text").alias("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns]
    return found.mapInArrow(unpack, schema).select(*columns)
