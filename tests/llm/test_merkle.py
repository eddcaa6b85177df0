"""The manifest against trees built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from samples import CLASHES, DOCS

from sectorscope.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(leaves, arity):
    """Root, and for each leaf the steps (slot, siblings) upwards."""
    proofs, above, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for k, at in enumerate(above):
            slot = at % arity
            run = runs[at // arity]
            proofs[k].append((slot, run[:slot] + run[slot + 1 :]))
            above[k] = at // arity
        level = [h(*run) for run in runs]
    return level[0], proofs


def fold(digest, proof):
    for slot, siblings in proof:
        digest = h(*siblings[:slot], digest, *siblings[slot:])
    return digest


def brute(rows, arity, tampered):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, roots = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, proofs = tree([leaf_of(r) for r in own], arity)
        roots.append(root)
        out.append((own, proofs, root))
    if not rows:
        return []
    top, tops = tree(roots, arity)
    found = []
    for (own, proofs, subroot), above in zip(out, tops):
        for row, proof in zip(own, proofs):
            way = proof + above
            changed = leaf_of(row[:4] + (row[4] + 1,)) if tampered(row) else leaf_of(row)
            siblings = h(*[s for _, step in way for s in step])
            found.append((row[0], leaf_of(row), subroot, top, siblings, fold(changed, way)))
    return sorted(found, key=str)


def result(docs, arity):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    text = merkle.digest_text
    found = merkle.manifest(docs, arity=arity, tampered={"n_chars": more}).select(
        "doc_id",
        text(F.col("leaf")),
        text(F.col("subroot")),
        text(F.col("root")),
        F.sha2(merkle.proof_texts(F.col("proof")), 256),
        merkle.folded(text(F.col("changed")), F.col("proof")),
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def is_tampered(row):
    return row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_trees(spark, arity):
    rng = random.Random(arity)
    langs = [None, "", "a", "b", "ä", "z\U0001f600", "many"]
    rows = [(k, f"text {k}" * rng.randrange(3), rng.choice(langs[:-1]), "s", k) for k in range(60)]
    rows += [(1000 + k, None if k % 9 == 0 else f"é{k}", "many", None, None if k % 5 == 0 else k) for k in range(130)]
    rows += [(5000, "alone", "lone", "s", 5)]
    rows += [(None, "no id", "many", "s", 1), (1003, "again", "many", "s", 1), (1003, "again", "many", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = brute(rows, arity, is_tampered)
    assert result(docs, arity) == want
    assert any(r[3] != r[5] for r in want) and any(r[3] == r[5] for r in want)


def test_one_row_and_one_group(spark):
    for rows in ([(1, "x", None, None, None)], [(k, "x", "en", "s", k) for k in range(9)]):
        assert result(spark.createDataFrame(rows, DOCS), 2) == brute(rows, 2, is_tampered)


def test_clashing_columns_and_very_long_texts(spark, odd_docs, clashing, no_docs):
    rows = [tuple(r) for r in odd_docs.collect()] + [(9000, "word " * 400_000, "en", "s", 1)]
    long = spark.createDataFrame(rows[-1:], DOCS)
    docs = clashing.unionByName(long.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]))
    docs = docs.withColumns({c: F.lit(1) for c in ("g", "size", "slot", "_group", "_n", "_size", "_part", "siblings", "proof")})
    assert result(docs, 2) == brute(rows, 2, is_tampered)
    assert result(no_docs, 2) == []


def test_arity(spark, odd_docs):
    with pytest.raises(ValueError):
        merkle.manifest(odd_docs, arity=1)
