"""Plain Python versions of what the operators must return; small inputs only."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(docs: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept), by links between all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for owners in where.values():
        for k, i in enumerate(owners):
            for j in owners[k + 1 :]:
                common[i, j] += 1
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        component = (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out
