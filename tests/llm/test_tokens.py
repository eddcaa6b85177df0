import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorscope.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab'sreltv .!?\n\t\r<|>_09é ß") + ["<|endoftext|>", " ", "\x1c", "\xa0", "　", "中", "\U0001f600", "  ", "'ll", "᠎"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=120).map("".join)


def whole(text):
    return tokens.open_tokenizer(PATH).encode(text, add_special_tokens=False).ids


def as_ids(raw):
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(texts, st.text(max_size=60)), max_size=4))
def test_encode_texts(parts):
    got = tokens.encode_texts(PATH, [*parts, None], 10**6, 10)
    assert [as_ids(x) for x in got] == [*[whole(t) for t in parts], []]


def test_every_token_is_its_own():
    """Merging by least id gives each token of the vocabulary as the library does."""
    alphabet, fast = tokens.byte_alphabet(), tokens.merging_by_id(PATH)
    special = set(fast.special_tokens_set)
    for token in tokens.open_tokenizer(PATH).get_vocab():
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not tokens.UNSETTLED.search(text):
            ids = fast.encode(text, allowed_special=special, disallowed_special=())
            assert ids == whole(text)


def test_other_makes_have_no_short_cut():
    assert tokens.merging_by_id(public_tokenizers.path("word_bpe_49k.json")) is None


@settings(max_examples=300, deadline=None)
@given(texts.map(lambda t: t * 3), st.integers(60, 200), st.integers(1, 40))
def test_resynchronised(text, chunk, overlap):
    got = [x for part in tokens.resynchronised(tokens.open_tokenizer(PATH), text, chunk, overlap) for x in part]
    assert got == whole(text)


@pytest.mark.parametrize(
    "text",
    [
        "y" * 5000,
        " " * 3000,
        " " * 1500 + "x" + " " * 1500,
        "ab " * 2000,
        "<|endoftext|>" * 300,
        "é" * 1000 + " z" * 1000,
        "!'" * 2000,
        "1" * 700 + "\n" * 700 + "a" * 700,
    ],
)
def test_resynchronised_long_runs(text):
    for chunk, overlap in ((64, 1), (100, 50), (1000, 10)):
        got = [x for part in tokens.resynchronised(tokens.open_tokenizer(PATH), text, chunk, overlap) for x in part]
        assert got == whole(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(spark, odd_docs, clashing, sf_dir, name):
    path = public_tokenizers.path(name)
    given_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (odd_docs, clashing, given_docs):
        got = sorted(map(tuple, tokens.token_counts(docs, path, 1024, chunk_chars=2000, overlap_chars=20).collect()), key=str)
        tokenizer = tokens.open_tokenizer(path)
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
        assert got == sorted(want, key=str)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokens.open_tokenizer(public_tokenizers.path("piece_bpe_32k.model"))


def test_random_documents():
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice(ALPHABET) * rng.randrange(1, 4) for _ in range(rng.randrange(5000)))
        got = [x for part in tokens.resynchronised(tokens.open_tokenizer(PATH), text, 300, 30) for x in part]
        assert got == whole(text)
