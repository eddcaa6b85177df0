"""Token counts and ids of whole texts, exactly as the tokenizer's library gives them.

A tokenizer file is opened once per Python worker.  Texts are encoded in two ways, both exact:

* **Huge texts** (over ``chunk_chars`` characters): overlapping chunks are encoded with
  offsets and spliced at a common boundary that is proven stable (:func:`resynchronised`).
  Memory is bounded by a chunk and the ids.
* **Other texts** are encoded as they are.  For a byte-level tokenizer whose merges are numbered
  in the order of its ids, merging by least id is the same rule, and a library made for that
  form does it several times faster; it is built from the same file.  Texts with characters
  that Unicode versions may class differently go to the tokenizer's own library.

Null text counts as empty: no tokens.  Rows are handled one by one, so repeated ids, ties and
empty tables need no rule; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Anything but Basic Latin to Latin Extended-A, Cyrillic letters, general punctuation, currency,
# kana and unified ideographs, whose classes have not changed for many Unicode versions.
UNSETTLED = re.compile(
    "[^\\x00-\\u017f\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20ac\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5]"
)
# The pre-tokenizer looks no further than this past the end of a match (contractions).
LOOK_AHEAD = 16

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
ROWS = 256


@lru_cache(maxsize=4)
def open_tokenizer(path: str):
    """The tokenizer in ``path`` (``.json``), without truncation or padding; one thread."""
    if not path.endswith(".json"):
        raise ValueError(f"Not a tokenizer definition: {path}")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _word_starts(encoding, base: int) -> dict[int, int]:
    """Place in the text of each pre-token's start -> index of its first token."""
    starts, last = {}, -1
    offsets = encoding.offsets
    for k, word in enumerate(encoding.word_ids):
        if word != last:
            starts[base + offsets[k][0]] = k
            last = word
    return starts


def resynchronised(
    tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> Iterator[list[int]]:
    """Ids of ``text``, in parts, from overlapping chunks.

    The first chunk starts where the text does, so its pre-tokens are those of the text except
    near its end, where the cut may change them: those that end a margin before the cut are
    right.  The margin covers the pre-tokenizer's look-ahead and the longest added token.  The
    next chunk starts ``overlap_chars`` before that cut.  Its first pre-tokens may be wrong,
    but where one of them starts at a start that is known to be right, it goes on as the whole
    text would, because a pre-token depends only on what follows its start.  That common start
    is the splice.  Without one the overlap is doubled; once it covers the whole right part,
    the chunk itself is doubled.
    """
    added = [len(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    margin = max([LOOK_AHEAD, *added])
    begin, size = 0, max(chunk_chars, 4 * margin)
    here = tokenizer.encode(text[:size], add_special_tokens=False)
    starts, first = _word_starts(here, 0), 0
    while True:
        end = begin + size
        if end >= len(text):
            yield here.ids[first:]
            return
        known = {p for p, k in starts.items() if p <= end - margin and k >= first}
        if not known:  # not one pre-token ends in this chunk: a longer one from the same place
            size *= 2
            here = tokenizer.encode(text[begin : begin + size], add_special_tokens=False)
            starts = _word_starts(here, begin)
            continue
        earliest, overlap = min(known), overlap_chars
        while True:
            back = max(end - overlap, earliest)
            following = tokenizer.encode(text[back : back + size], add_special_tokens=False)
            next_starts = _word_starts(following, back)
            # The first start of a chunk is its own cut, and right only if it is known.
            common = known & next_starts.keys()
            if common and (back > begin or max(common) > begin):
                break
            if back == earliest:
                break
            overlap *= 2
        splice = max(common) if common else earliest
        if splice == begin:  # nothing gained: a longer chunk from the same place
            size *= 2
            here = tokenizer.encode(text[begin : begin + size], add_special_tokens=False)
            starts = _word_starts(here, begin)
            continue
        yield here.ids[first : starts[splice]]
        here, starts, first, begin = following, next_starts, next_starts[splice], back
        size = max(chunk_chars, 4 * margin)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def merging_by_id(path: str):
    """An encoding equal to the tokenizer's on settled texts, or None for one of another make."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        definition = json.load(file)
    splitter, model = definition.get("pre_tokenizer") or {}, definition["model"]
    plain = (
        definition.get("normalizer") is None
        and definition.get("post_processor") is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in definition["added_tokens"])
    )
    if not plain:
        return None
    added = {t["content"]: t["id"] for t in definition["added_tokens"]}
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocabulary.get(m.replace(" ", "", 1)) != 256 + k for k, m in enumerate(merges)):
        return None
    ranks = {bytes(alphabet[c] for c in token): n for token, n in vocabulary.items() if token not in added}
    return tiktoken.Encoding("by-id", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode_texts(path: str, texts: list[str | None], chunk_chars: int, overlap_chars: int) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    tokenizer, fast = open_tokenizer(path), merging_by_id(path)
    special = set(fast.special_tokens_set) if fast else set()
    out: list[bytes] = [b""] * len(texts)
    others = []
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > chunk_chars:
            out[k] = b"".join(_bytes(ids) for ids in resynchronised(tokenizer, text, chunk_chars, overlap_chars))
        elif fast and not UNSETTLED.search(text):
            out[k] = _bytes(fast.encode_to_numpy(text, allowed_special=special, disallowed_special=()))
        else:
            others.append(k)
    for k, encoding in zip(others, tokenizer.encode_batch([texts[k] for k in others], add_special_tokens=False)):
        out[k] = _bytes(encoding.ids)
    return out


def encoded_slices(
    batches: Iterator[pa.RecordBatch], path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a few rows (``doc_id``, ``text``) with the ids of their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = batch.slice(k, ROWS)
            yield rows, encode_texts(path, rows.column("text").to_pylist(), chunk_chars, overlap_chars)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    No shuffle; one pass over the texts.
    """
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in encoded_slices(batches, tokenizer_path, chunk_chars, overlap_chars):
            tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", "text", size).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
