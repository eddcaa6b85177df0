"""Schemas and texts for tests."""

import random

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, and names that need quoting.
CLASHES = ["_key", "_id", "_row", "_text", "_tag", "h", "n", "kept", "label", "line", "path", "component_id", "a.b", "`x"]


def prose(seed: int, words: int, vocabulary: int = 400, per_line: int = 12) -> str:
    rng = random.Random(seed)
    out = [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)
