"""Benchmark decontamination as a prefix-filtered set join.

DataFrame functions only.  A window (a run of ``size`` item words; the whole item where it is
shorter) occurs in a document when all its shingles do, at their places.  So every document
that holds it holds its rarest shingle, and a prefix of one token is the necessary one:

1. The shingles of all windows are counted in all documents (partial counts, one pass).
2. Each window is keyed by its rarest shingle; ties go to the lower hash.
3. Documents are joined with the keys on the shingle.  The place of the key in the window
   bounds where the window must start, and window and document lengths bound whether it
   fits; what is left is verified word by word.

The benchmark side is broadcast in blocks of at most ``block`` windows, each counted before;
a benchmark over one block takes one pass of the documents for each, so the broadcast stays
bounded and nothing is left out.  A document's occurrences are gathered once, by document.

Null or empty texts have no words: documents get zeros, items no window.  Repeated items
(equal ids or texts) each count by id; a null item id is left out of the list of ids but its
windows do hit.  Rows repeated in doc_id and text share one result and are each returned.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import content_key, keep_rows
from sectorscope.sources.paths import store

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
BLOCK_WINDOWS = 50_000


def benchmark_words(text: Column) -> Column:
    """Words after lower-casing A-Z and nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def _shingles(tokens: Column, width: int) -> Column:
    """(hash, place) of every run of ``width`` tokens."""
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens) - width),
        lambda i: F.struct(
            F.xxhash64(*[F.get(tokens, i + k) for k in range(width)], F.lit(width)).alias("shingle"), i.alias("at")
        ),
    )


def _safe_shingles(tokens: Column, width: int) -> Column:
    none = F.array().cast("array<struct<shingle:bigint,at:int>>")
    return F.when(F.size(tokens) >= width, _shingles(tokens, width)).otherwise(none)


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows: ``words``, ``width`` of their shingles, and the ids of their items."""
    tokens = items.select("item_id", benchmark_words(F.coalesce("text", F.lit(""))).alias("w"))
    tokens = tokens.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = tokens.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return (
        windows.groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    )


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("_id"),
        content_key(F.col("doc_id"), F.col("text")).alias("_key"),
        benchmark_words(F.coalesce("text", F.lit(""))).alias("w"),
    )


def _document_shingles(documents: DataFrame, widths: list[int]) -> DataFrame:
    parts = [_safe_shingles(F.col("w"), width) for width in widths]
    together = F.concat(*parts) if len(parts) > 1 else parts[0]
    return documents.select("_id", "_key", "w", F.inline(together))


def _keys(documents: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """Per key shingle, the windows it is the rarest of: words, place of the key, number."""
    parts = F.lit(None)
    for width in widths:
        parts = F.when(F.col("width") == width, _safe_shingles(F.col("words"), width)).otherwise(parts)
    of_window = windows.select("window", F.inline(parts))
    wanted = F.broadcast(of_window.select("shingle").distinct())
    counts = _document_shingles(documents, widths).join(wanted, "shingle").groupBy("shingle").count()
    rarest = (
        of_window.join(counts, "shingle")  # a shingle in no document: its window is in none
        .groupBy("window")
        .agg(F.min(F.struct("count", "shingle", "at")).alias("k"), F.count("*").alias("found"))
    )
    all_there = F.col("found") == F.size("words") - F.col("width") + 1
    return (
        windows.join(rarest, "window")
        .where(all_there)
        .select(F.col("k.shingle").alias("shingle"), F.struct("words", F.col("k.at").alias("at"), "window").alias("c"))
        .groupBy("shingle")
        .agg(F.collect_list("c").alias("candidates"))
    )


def _occurrences(documents: DataFrame, keys: DataFrame, widths: list[int]) -> DataFrame:
    """Verified occurrences: ``_id``, ``_key``, ``start``, ``length``, ``window``."""
    met = _document_shingles(documents, widths).join(F.broadcast(keys), "shingle")

    def verified(c: Column) -> Column:
        start = F.col("at") - c["at"]
        fits = (start >= 0) & (start + F.size(c["words"]) <= F.size("w"))
        # slice counts from 1; the bounds come first, so it never sees a place outside
        return F.when(fits, F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size(c["words"])) == c["words"]).otherwise(
            False
        )

    found = met.select("_id", "_key", "at", F.explode(F.filter("candidates", verified)).alias("c"))
    return found.select(
        "_id",
        "_key",
        (F.col("at") - F.col("c.at")).alias("start"),
        F.size("c.words").alias("length"),
        F.col("c.window").alias("window"),
    )


def covered_words(spans: Column) -> Column:
    """Words in the union of ``(start, length)`` spans, given in order of their starts."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, empty, add, lambda s: s["n"])


def find_contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, block: int = BLOCK_WINDOWS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``items`` (item_id, text): ``doc_id``,
    ``n_words``, ``n_hit``, ``items`` (ids), ``spans`` (of words, first word 0), ``_id``, ``_key``.

    Runs jobs: the windows are stored and counted before they are broadcast.
    """
    windows = item_windows(items, size).withColumn("window", F.monotonically_increasing_id())
    windows = store(windows, "windows")
    total = windows.count()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())
    documents = _documents(docs)
    found = []
    blocks = -(-total // block)
    for number in range(blocks):
        part = windows
        if blocks > 1:
            part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        narrow = part.select("window", "words", "width")
        keys = store(_keys(documents, narrow, widths), "window-keys")
        found.append(_occurrences(documents, keys, widths))
    sized = documents.select("_id", "_key", F.size("w").cast("long").alias("n_words"))
    if not found:
        none = F.array().cast("array<struct<start:int,length:int>>")
        return sized.select(
            F.col("_id").alias("doc_id"),
            "n_words",
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<bigint>").alias("items"),
            none.alias("spans"),
            "_id",
            "_key",
        )
    hits = reduce(DataFrame.unionByName, found)
    hits = hits.join(windows.select("window", "items"), "window")
    per_document = hits.groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    left, right = sized.alias("l"), per_document.alias("r")
    same = (F.col("l._key") == F.col("r._key")) & F.col("l._id").eqNullSafe(F.col("r._id"))
    spans = F.coalesce("r.spans", F.array().cast("array<struct<start:int,length:int>>"))
    return left.join(right, same, "left").select(
        F.col("l._id").alias("doc_id"),
        "l.n_words",
        covered_words(spans).alias("n_hit"),
        F.coalesce("r.items", F.array().cast("array<bigint>")).alias("items"),
        spans.alias("spans"),
        F.col("l._id").alias("_id"),
        F.col("l._key").alias("_key"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without a single hit, unchanged."""
    clean = find_contamination(docs, items, size).where(F.col("n_hit") == 0)
    return keep_rows(docs, clean, ["doc_id", "text"])
