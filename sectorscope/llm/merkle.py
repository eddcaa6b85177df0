"""Merkle manifest of a dataset: a tree for each group, and a tree over the groups' roots.

A row's leaf is the SHA-256 of its fields.  In each group the leaves ascend by id, and every
``arity`` consecutive nodes (the last run may be shorter, down to one) become the SHA-256 of their
digests, until one is left.  The groups' roots, in order of the groups, form a tree of their own.

* Leaves are numbered in range partitions, so a group that holds most rows is spread over tasks.
* Every level is an equijoin of its nodes with themselves by a computed number of the sibling:
  ``n XOR 1`` in a binary tree, else the same run at the slot that is 1, 2, ... further on.  The
  rows at slot zero then emit the parents.  The levels are stored, so a lost executor costs one level.
* Proofs go down again: the nodes of a level take over what their parents hold, so every
  level is joined once with one of a fraction of its rows, never all leaves with all levels.

Null fields are written as ``-``, other ones as byte count, colon, value.  A null id comes before
all others; repeated ids follow each other by leaf.  A null group is a group and the first one.
An empty table has no rows and no root.  Texts of any length are hashed in the JVM, where they are read;
only digests move.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import quoted
from sectorscope.llm.numbering import numbered
from sectorscope.operators.sizing import lookup_join
from sectorscope.sources.paths import store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels joined in one plan on the way down, before their proofs are stored.
LEVELS_TOGETHER = 6
_STEP = "array<struct<slot:int,siblings:array<binary>>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, as bytes."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digest_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.concat_ws("", F.transform(digests, digest_text))


def _with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """The nodes with ``siblings``: the other digests of their run, left to right."""
    slot = F.col("n") % F.lit(arity)
    rows, found = level, []
    for k in range(1, arity):
        moved = F.col("n").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("n") - slot + (slot + F.lit(k)) % F.lit(arity)
        other = level.select(F.col("g").alias("_g"), F.col("n").alias(f"_n{k}"), F.col("h").alias(f"_h{k}"))
        rows = rows.withColumn("_to", moved)
        rows = rows.join(other, (F.col("g") == F.col("_g")) & (F.col("_to") == F.col(f"_n{k}")), "left").drop("_g", "_to")
        found.append(F.struct(F.col(f"_n{k}").alias("n"), F.col(f"_h{k}").alias("h")))
    present = F.sort_array(F.filter(F.array(*found), lambda s: s["n"].isNotNull()))
    return rows.select(
        *level.columns,
        slot.cast("int").alias("slot"),
        F.transform(present, lambda s: s["h"]).alias("siblings"),
    )


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """Slot zero of every run emits its parent."""
    text = F.concat(digest_text(F.col("h")), _joined(F.col("siblings")))
    return level.where("slot = 0").select(
        "g",
        F.expr(f"n div {arity}").alias("n"),
        F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
        F.unhex(F.sha2(text, 256)).alias("h"),
    )


def tree_proofs(leaves: DataFrame, arity: int = 2) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (``g``, ``n`` from 0 in each ``g``, ``size`` of ``g``, digest ``h``, more columns).

    Returns the leaves with ``proof`` (steps from the leaf to the root of its group: slot, and the
    siblings left to right) and the roots (``g``, ``h``).  Runs a job for each level.
    """
    if arity < 2:
        raise ValueError("A run has at least two nodes")
    more = [c for c in leaves.columns if c not in ("g", "n", "size", "h")]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    level, levels = leaves, []
    roots = leaves.where("size = 1").select("g", "h")
    while largest > 1:
        levels.append(store(_with_siblings(level.where("size > 1"), arity), f"tree-level-{len(levels)}"))
        level = _parents(levels[-1], arity)
        roots = roots.unionByName(level.where("size = 1").select("g", "h"))
        largest = -(-largest // arity)

    nothing = F.array().cast(_STEP)
    above = None
    for k in reversed(range(len(levels))):
        step = F.array(F.struct("slot", "siblings")).cast(_STEP)
        keep = ["g", "n", "size", "h", *more] if k == 0 else ["g", "n"]
        if above is None:
            above = levels[k].select(*keep, step.alias("proof"))
            continue
        up = above.select(F.col("g").alias("_g"), F.col("n").alias("_up"), F.col("proof").alias("_proof"))
        nodes = levels[k].withColumn("_parent", F.expr(f"n div {arity}"))
        joined = nodes.join(up, (F.col("g") == F.col("_g")) & (F.col("_parent") == F.col("_up")), "left")
        above = joined.select(*keep, F.concat(step, F.coalesce("_proof", nothing)).alias("proof"))
        if k and k % LEVELS_TOGETHER == 0:
            above = store(above, f"proofs-{k}")
    lone = leaves.where("size = 1").withColumn("proof", nothing)
    return (lone if above is None else above.unionByName(lone.select(*above.columns))), store(roots, "roots")


def folded(digest: Column, proof: Column) -> Column:
    """The root, as text, that follows from a leaf's text digest and its proof."""

    def up(text: Column, step: Column) -> Column:
        left = F.slice(step["siblings"], F.lit(1), step["slot"])
        right = F.slice(step["siblings"], step["slot"] + 1, F.size(step["siblings"]) + 1)
        return F.sha2(F.concat(_joined(left), text, _joined(right)), 256)

    return F.aggregate(proof, digest, up)


def proof_texts(proof: Column) -> Column:
    """The digests of a proof, as text, one after the other."""
    return F.concat_ws("", F.transform(proof, lambda step: _joined(step["siblings"])))


def manifest(
    docs: DataFrame, group: str = "lang", arity: int = 2, tampered: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``g`` (number of its group), ``leaf``, ``subroot``, ``root``
    (bytes), ``proof`` (steps to the root over all), and ``changed``: the leaf of the row with the
    columns named in ``tampered`` replaced, equal to ``leaf`` without any.
    """
    fields = [F.col(quoted(c)) for c in FIELDS]
    other = [(tampered or {}).get(c, F.col(quoted(c))) for c in FIELDS]
    rows = docs.select(
        F.col("doc_id"),
        F.col(quoted(group)).alias("_group"),
        leaf(fields).alias("h"),
        (leaf(other) if tampered else leaf(fields)).alias("changed"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("_tie")]
    leaves = numbered(rows, "leaves", ["_group"], order)
    groups = leaves.where("_n = 0").select("_group")
    groups = numbered(groups, "groups", order=[F.col("_group").asc_nulls_first()])
    # A key that no other group has, null included.
    key = F.coalesce(F.concat(F.lit(":"), F.col("_group").cast("string")), F.lit("")).alias("_key")
    leaves = lookup_join(leaves.select("*", key), groups.select(key, F.col("_n").alias("g")), "_key", "inner")
    leaves = leaves.select("g", F.col("_n").alias("n"), F.col("_size").alias("size"), "h", "doc_id", "changed")
    proven, subroots = tree_proofs(store(leaves, "numbered-leaves"), arity)

    count = groups.select(F.col("_n").alias("g"), F.col("_size").alias("size"))
    tops = subroots.join(count, "g").select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("n"), "size", "h", F.col("g").alias("group_no")
    )
    top_proofs, root = tree_proofs(store(tops, "subroots"), arity)
    # One row: all groups have the same root.
    top = top_proofs.join(F.broadcast(root.select("g", F.col("h").alias("root"))), "g").select(
        F.col("group_no").alias("g"), F.col("h").alias("subroot"), "root", F.col("proof").alias("_above")
    )
    found = lookup_join(proven, top, "g", "inner")
    return found.select(
        "doc_id", "g", F.col("h").alias("leaf"), "subroot", "root", "changed",
        F.concat("proof", "_above").alias("proof"),
    )
