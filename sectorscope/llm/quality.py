"""Quality rules: repetition inside a document, and lines frequent across documents.

DataFrame functions only.  Every text is parsed once, into a narrow table of measures and
line hashes that is written to the shared folder; all counting starts from there.

* Inside a document: words, symbols, repeated lines, and words inside 3-word windows that
  occur twice or more.
* Across documents: normalised lines (lower case, digit runs as ``0``, trimmed) are hashed,
  and per host the distinct documents that carry a line are counted.  Documents of equal
  text count once, so a group of exact copies cannot make its own lines frequent; documents
  which differ in digits only are several.  A line in more than ``max_line_docs`` documents,
  whatever the size of the host, is removed everywhere but in the document with the lowest
  id that carries it: a group of near copies above the limit keeps one whole document.  A
  document that loses more than ``max_loss`` of its line characters is depleted and rejected.

:func:`quality_rules` returns measures and verdicts, :func:`keep_good` the rows that pass as they
are, :func:`clean_good` the rows that pass without their frequent lines.

Very long texts are handled whole, in time near proportional to their length; a row's lines and
windows have to fit in a task's memory.

Null text: no words, base rules fail.  Null host: a host of its own.  Null id: judged like
any other row, but never the first carrier of a line.  Rows repeated in all of id, host and
text are each returned with the same verdict.  Extra columns are ignored.  An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import NOT_SPACE, content_key, keep_rows, quoted, words
from sectorscope.sources.paths import store

SYMBOLS = r"[#*$%&|<>]"


def window_hashes(tokens: Column, size: int = 3) -> Column:
    """64-bit hash of every run of ``size`` tokens, in order; empty for fewer tokens."""
    starts = F.sequence(F.lit(0), F.size(tokens) - size)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))
    return F.when(F.size(tokens) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def _named(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a transform over a one-element array."""
    return F.transform(F.array(value), then)[0]


def _places_by_lookup(windows: Column, repeated: Column) -> Column:
    marked = F.transform(windows, lambda h, i: F.when(F.array_contains(repeated, h), i))
    return F.array_compact(marked)


def _places_by_sorting(windows: Column) -> Column:
    def marked(pairs: Column) -> Column:
        def at(k: Column) -> Column:
            return F.get(pairs, k)["h"]

        both = F.filter(
            pairs,
            lambda p, k: F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(both, lambda p: p["i"]))

    return _named(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)


def covered_by_repeats(windows: Column, size: int = 3, few: int = 256) -> Column:
    """Words inside windows whose hash occurs at least twice in the array.

    The repeated hashes are neighbours once sorted.  Their places come from a lookup in that
    list or, where it is longer than ``few``, from sorting hashes with places, so that a very
    long text does not cost its square.  Each place adds the words up to the next one,
    ``size`` at most.
    """

    def total(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(size)), F.lit(size))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def places(repeated: Column) -> Column:
        return (
            F.when(F.size(repeated) == 0, F.array().cast("array<int>"))
            .when(F.size(repeated) <= few, _places_by_lookup(windows, repeated))
            .otherwise(_places_by_sorting(windows))
        )

    def repeats(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, k: F.coalesce(F.get(ordered, k + 1) == h, F.lit(False))))

    found = _named(_named(_named(F.sort_array(windows), repeats), places), total)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))


def normal_lines(text: Column) -> Column:
    """Every line in lower case, with digit runs as ``0``, trimmed."""
    normal = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "\n")
    return F.transform(normal, lambda x: F.trim(x))


def measures(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per row: id, key, host, the text's key, the base measures and the hashes and sizes of its lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_host"),
        content_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("_key"),
        text.alias("_text"),
        content_key(F.col("text")).alias("_body"),
    )
    rows = rows.select(
        "_id",
        "_host",
        "_key",
        "_body",
        words(F.col("_text")).alias("_words"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_raw"),
        F.filter(normal_lines(F.col("_text")), lambda x: x.rlike(NOT_SPACE)).alias("_normal"),
    )
    rows = rows.select(
        "_id",
        "_host",
        "_key",
        "_body",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("_words")).alias("_windows"),
        F.transform(
            "_normal", lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).cast("long").alias("chars"))
        ).alias("_lines"),
    )
    rows = rows.withColumn("n_repeat_words", covered_by_repeats(F.col("_windows"))).drop("_windows")
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.lit(max_repeat_percent).cast("long") * F.col("n_words")
    )
    return rows.withColumn("base_failed", failed)


def _line_set() -> Column:
    return F.sort_array(F.array_distinct(F.transform("_lines", lambda x: x["h"])))


def frequent_lines(measured: DataFrame, max_docs: int) -> DataFrame:
    """Lines (host, hash) of more than ``max_docs`` distinct texts, with the lowest id that carries them.

    Copies collapse before lines are spread out, and every count is partially aggregated
    before its shuffle, so neither a hot host nor a hot line meets in one task.
    """
    bodies = measured.withColumn("_set", _line_set()).groupBy("_host", "_set", "_body").agg(F.min("_id").alias("_first"))
    return (
        bodies.select("_host", "_first", F.explode("_set").alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count("*").alias("_n"), F.min("_first").alias("_first"))
        .where(F.col("_n") > max_docs)
    )


def _judged(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_line_docs: int = 20,
    max_loss: float = 0.7,
) -> DataFrame:
    """:func:`quality_rules`, and ``_gone``: the hashes of the frequent lines to remove, or null."""
    measured = measures(docs, min_words, max_repeat_percent)
    # The number of a row is fixed once it is written.
    measured = store(measured.withColumn("_row", F.monotonically_increasing_id()), "quality")
    frequent = frequent_lines(measured, max_line_docs).select("_host", F.col("_line").alias("h"), "_first")
    lost = (
        measured.select("_row", "_id", "_host", F.inline("_lines"))
        .join(frequent, ["_host", "h"])
        .where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_row")
        .agg(F.sum("chars").alias("_lost"), F.collect_set("h").alias("_gone"))
    )
    judged = measured.join(lost, "_row", "left")
    total = F.aggregate(F.col("_lines"), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    removed = F.coalesce(F.col("_lost"), F.lit(0).cast("long"))
    return judged.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        total.alias("line_chars"),
        removed.alias("frequent_chars"),
        (~F.col("base_failed") & (removed <= total * F.lit(max_loss))).alias("kept"),
        "_id",
        "_key",
        "_gone",
    )


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One verdict per row of ``docs`` (doc_id, source, text).

    Returns ``doc_id``, the measures, ``base_failed``, ``line_chars``, ``frequent_chars`` (in
    lines removed as frequent), ``kept``, and ``_id``/``_key`` for :func:`keep_good`.
    Runs one job, which writes the measures.
    """
    return _judged(docs, **limits).drop("_gone")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass :func:`quality_rules`, unchanged."""
    return keep_rows(docs, quality_rules(docs, **limits).where("kept"), ["doc_id", "source", "text"])


def clean_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, without their frequent lines in ``text`` but in the first
    document that carries them; ``n_chars`` follows the text."""
    judged = _judged(docs, **limits).where("kept")
    # Rows that agree in id, host and text share their lines.
    judged = judged.groupBy("_id", "_key").agg(F.first("_gone", ignorenulls=True).alias("_gone"))
    left = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"),
        F.col("doc_id").alias("_id"),
        content_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("_key"),
    ).alias("l")
    right = judged.alias("r")
    same = (F.col("l._key") == F.col("r._key")) & F.col("l._id").eqNullSafe(F.col("r._id"))
    rows = left.join(right, same).select("l._row", "r._gone")
    hashes = F.transform(normal_lines(F.col("_row")["text"]), lambda x: F.xxhash64(x))
    lines = F.arrays_zip(F.split(F.col("_row")["text"], "\n").alias("line"), hashes.alias("h"))
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col("_gone"), x["h"]))
    cleaned = F.array_join(F.transform(stays, lambda x: x["line"]), "\n")
    rows = rows.withColumn("_text", F.when(F.col("_gone").isNotNull(), cleaned).otherwise(F.col("_row")["text"]))
    columns = []
    for field in docs.schema:
        value = F.col("_row")[field.name]
        if field.name == "text":
            value = F.col("_text")
        elif field.name == "n_chars":
            size = F.char_length("_text").cast(field.dataType)
            value = F.when(F.col("_gone").isNotNull(), size).otherwise(value)
        columns.append(value.alias(field.name))
    return rows.select(*columns)
