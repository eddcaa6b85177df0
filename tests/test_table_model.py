"""The table model against plain Python."""

import math
from collections import Counter

import pytest
from helpers import values

from sectorscope.operators import table_model as tm

ROWS = [
    (1, "the cat sat the cat", 0),
    (2, "The dog", 1),
    (3, "cat cat dog", 0),
    (4, None, 1),
    (5, "", 1),
    (6, "bird the the", 1),
    (7, "unlabelled words", None),
]
SCHEMA = "id long, text string, label int"


def brute(rows, n_classes):
    known = [(set((t or "").lower().split()), Counter((t or "").lower().split()), k) for _, t, k in rows if k is not None]
    words = set().union(*[w for w, _, _ in known])
    total = [sum(sum(c.values()) for _, c, k in known if k == i) + len(words) for i in range(n_classes)]
    out = {}
    for word in words:
        idf = math.log((len(known) + 1) / (sum(word in w for w, _, _ in known) + 1))
        out[word] = [
            idf * math.log((sum(c[word] for _, c, k in known if k == i) + 1) / total[i]) for i in range(n_classes)
        ]
    return out


def test_weights_and_scores(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    weights = tm.fit_weights(rows, 2)
    want = brute(ROWS, 2)
    found = {r["word"]: r["weights"] for r in weights.collect()}
    assert found.keys() == want.keys()
    assert all(found[w] == pytest.approx(want[w]) for w in want)
    asked = spark.createDataFrame([(1, "cat zebra bird cat"), (2, "zebra"), (3, None)], "id long, text string")
    scores = dict(values(tm.score_words(asked, weights, 2), "id"))
    assert scores[1] == pytest.approx([(2 * want["cat"][k] + want["bird"][k]) / 3 for k in range(2)])
    assert scores[2] == scores[3] == [0.0, 0.0]


def test_more_weights_than_are_broadcast(spark, monkeypatch):
    from sectorscope.operators import sizing

    rows = spark.createDataFrame(ROWS, SCHEMA)
    weights = tm.fit_weights(rows, 2)
    want = values(tm.score_words(rows, weights, 2), "id")
    monkeypatch.setattr(sizing.lookup_join, "__defaults__", (2,))
    assert [r[0] for r in values(tm.score_words(rows, weights, 2), "id")] == [r[0] for r in want]
    for (_, a), (_, b) in zip(values(tm.score_words(rows, weights, 2), "id"), want):
        assert a == pytest.approx(b)


def test_objective_falls_and_gradient_is_its_slope(spark):
    data = [(k, [0.1 * k, 0.3 - 0.05 * k, 0.0], k % 3 if k % 4 else 0) for k in range(12)]
    scored = spark.createDataFrame(data, "id long, logits array<double>, label int")
    offsets = [0.2, -0.1, 0.4]
    value, gradient = tm.objective(scored, offsets, 0.3)
    loss = 0.0
    for _, z, y in data:
        e = [math.exp(a + b) for a, b in zip(z, offsets)]
        loss -= math.log(e[y] / sum(e)) / len(data)
    assert value == pytest.approx(loss + 0.15 * sum(b * b for b in offsets))
    for k in range(3):
        moved = [b + (1e-5 if i == k else 0) for i, b in enumerate(offsets)]
        assert (tm.objective(scored, moved, 0.3)[0] - value) / 1e-5 == pytest.approx(gradient[k], abs=1e-4)
    fitted, curve = tm.fit_offsets(scored, 3, steps=5, rate=1.0, penalty=0.01)
    steps = [r["value"] for r in curve.orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True) and len(steps) == 6 and len(fitted) == 3
    with pytest.raises(ValueError):
        tm.objective(scored.limit(0), offsets, 0.3)


def test_most_words_stay_where_their_row_is(spark):
    """Words of the broadcast part and the others add up, and a job shuffles few of them."""
    data = [(k, " ".join(["the", "of", f"w{k % 7}", f"rare{k}", "The", f"w{k % 5}"]), k % 2) for k in range(60)]
    rows = spark.createDataFrame(data, SCHEMA)
    weights = tm.fit_weights(rows, 2)
    want = brute(data, 2)
    assert {r["word"]: pytest.approx(r["weights"]) for r in weights.collect()} == want
    for bound in (0, 3, 20, 10_000):
        scores = dict(values(tm.score_words(rows, weights, 2, max_rows=bound), "id"))
        for k, text, _ in data:
            mine = [want[w] for w in text.lower().split()]
            assert scores[k] == pytest.approx([sum(w[c] for w in mine) / len(mine) for c in range(2)])
    condition, is_all = tm._frequent(weights, 20)
    assert not is_all and 0 < weights.where(condition).count() <= 20
    plan = tm._counted_words(rows, "text", "label", "id", None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rows_that_share_an_id_count_as_one(spark):
    data = [(1, "cat cat", 0), (1, "cat dog", 0), (1, "cat", 1), (None, "cow", 1), (None, "cow cow", 1), (2, "dog", 1)]
    found = {r["word"]: r for r in tm.fit_weights(spark.createDataFrame(data, SCHEMA), 2).collect()}
    rows_with = {"cat": 2, "dog": 2, "cow": 1}
    assert {w: r["idf"] for w, r in found.items()} == {w: pytest.approx(math.log(7 / (d + 1))) for w, d in rows_with.items()}
    counts = {"cat": (3, 1), "dog": (1, 1), "cow": (0, 3)}
    for word, c in counts.items():
        share = [math.log((c[k] + 1) / (sum(x[k] for x in counts.values()) + 3)) for k in range(2)]
        assert found[word]["weights"] == pytest.approx([found[word]["idf"] * s for s in share])
