import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorscope.functions import scores as sc
from sectorscope.operators import classify as cl
from sectorscope.operators import corpus, summary
from sectorscope.plans import evaluate as pe
from sectorscope.plans import score as ps
from sectorscope.plans.train import train_classifier
from sectorscope.sources import readers, writers

CODES = ["11", "52", "62"]
WORDS = {"11": "farm crop field", "52": "bank money loan", "62": "nurse clinic health"}


def labels(spark):
    return spark.createDataFrame(list(enumerate(CODES)), "label int, code string")


def word_scorer(words):
    def open_scorer():
        def score(texts):
            return np.array([[sum(w in t for w in group) for group in words] for t in texts], dtype=float)

        return score

    return open_scorer


def add_scores(df):
    return cl.score_with(df, word_scorer([WORDS[c].split() for c in CODES]), batch_size=2)


def repos(spark, per_class=30):
    rows = [
        (i * 10 + k, code, f"repo{i}", WORDS[code] + f" text{i}")
        for i in range(per_class)
        for k, code in enumerate(CODES)
    ]
    return spark.createDataFrame(rows, "id long, code string, name_repo string, readme_content string")


def test_score_expressions(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.5, 0.5, 0.0],)], "p array<double>")
    p = F.col("p")
    rows = df.select(sc.argmax(p).alias("a"), sc.top_k(p, 2).alias("t")).collect()
    assert [r.a for r in rows] == [1, 0]
    assert [(e.class_index, e.score) for e in rows[0].t] == [(1, 0.7), (2, 0.2)]
    assert [e.class_index for e in rows[1].t] == [0, 1]


def test_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, float(np.log(3))],)], "z array<double>")
    got = [r[0] for r in df.select(sc.softmax(F.col("z"))).collect()]
    assert got[0] == [0.5, 0.5]
    assert got[1] == pytest.approx([0.25, 0.75])


def test_external_scorer(spark):
    df = spark.createDataFrame([(1, "a bank loan"), (2, "nurse"), (3, "none")], "id int, text string")
    rows = cl.classify(add_scores(df), labels(spark), keep_scores=True).orderBy("id").collect()
    assert [r.predicted_naics for r in rows] == ["52", "62", "11"]
    assert rows[2].confidence == pytest.approx(1 / 3)
    assert rows[0].confidence == pytest.approx(np.exp(2) / (np.exp(2) + 2))


def test_top_classes_and_score_map(spark):
    df = spark.createDataFrame([(1, [0.1, 0.7, 0.2])], "id int, probabilities array<double>")
    top = cl.top_classes(df, labels(spark), 2, ["id"]).orderBy("rank").collect()
    assert [(r["rank"], r.predicted_naics, r.score) for r in top] == [(1, "52", 0.7), (2, "62", 0.2)]
    assert cl.all_scores(df, CODES).first().all_scores == {"11": 0.1, "52": 0.7, "62": 0.2}


def test_score_corpus_keeps_columns(spark):
    rows = repos(spark, 3).withColumn("extra", F.lit(1))
    out = ps.score_corpus(rows, add_scores, labels(spark))
    assert out.columns == [*rows.columns, "predicted_naics", "confidence", "naics_description"]
    assert out.where("predicted_naics <> code").count() == 0
    assert ps.score_corpus(rows, add_scores, labels(spark), limit=4, order_by="id").count() == 4


def test_summaries(spark):
    scored = ps.predict_table(repos(spark, 4), add_scores, labels(spark))
    total = summary.scoring_summary(scored).orderBy("rank").collect()
    assert [(r.total, r["rank"], r.predicted_naics, r.industry, r.n, round(r.pct, 2)) for r in total] == [
        (12, 1, "11", "Agriculture, Forestry, Fishing and Hunting", 4, 33.33),
        (12, 2, "52", "Finance and Insurance", 4, 33.33),
        (12, 3, "62", "Health Care and Social Assistance", 4, 33.33),
    ]
    assert [tuple(r) for r in summary.prediction_distribution(scored).collect()] == [("11", 4), ("52", 4), ("62", 4)]
    assert summary.sample_preview(scored).columns == ["name_repo", "predicted_naics", "confidence", "naics_description"]
    assert summary.sample_preview(scored, 5).count() == 5


def test_classify_repositories_from_dicts(spark):
    demo = [
        {"repo_name": "bank-api", "description": "bank money", "readme": "loan"},
        {"repo_name": "farm-tracker", "readme": "Track crop and field"},
    ]
    rows = readers.from_rows(spark, demo, "repo_name string, description string, readme string")
    out = ps.classify_repositories(rows, add_scores, labels(spark)).orderBy("repo_name").collect()
    assert [(r.naics_code, r.industry) for r in out] == [
        ("52", "Finance and Insurance"),
        ("11", "Agriculture, Forestry, Fishing and Hunting"),
    ]
    assert out[0].confidence == f"{np.exp(3) / (np.exp(3) + 2):.2%}"


def test_train_save_load_score(spark, tmp_path):
    run = train_classifier(
        repos(spark), min_samples=10, reg_params=(0.001, 1.0), max_iter=5, n_features=256, save_to=str(tmp_path / "m")
    )
    rows = {r.split: r for r in run.metrics.collect()}
    assert set(rows) == {"validation", "test"}
    assert rows["test"].f1 == 1.0
    assert run.gap.first().status == "good"
    curve = [r.value for r in run.curve.orderBy("step").collect()]
    assert len(curve) >= 2 and curve[-1] < curve[0]

    model, stored = writers.load_model(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in stored.orderBy("label").collect()] == list(enumerate(CODES))
    scored = ps.score_corpus(repos(spark, 3), lambda df: cl.score_with_model(df, model), stored)
    assert scored.where("predicted_naics <> code").count() == 0

    writers.save_model(model, None, str(tmp_path / "bare"))
    _, own = writers.load_model(spark, str(tmp_path / "bare"))
    assert [tuple(r) for r in own.orderBy("label").collect()] == list(enumerate(CODES))


def test_evaluate_table(spark):
    result = pe.evaluate_table(repos(spark), add_scores, labels(spark))
    assert result.test_size.first().n_test == 18
    assert result.metrics.first().f1 == 1.0
    assert {r["class"] for r in result.report.collect()} == {*CODES, "accuracy", "macro avg", "weighted avg"}
    assert result.matrix.count() == 9
    assert [r["class"] for r in result.ranking.collect()] == ["62", "52", "11"]


@pytest.mark.parametrize("target", ["out.csv", "out.parquet"])
def test_score_file(spark, tmp_path, target):
    source = str(tmp_path / "in.parquet")
    repos(spark, 4).write.parquet(source)
    total = ps.score_file(spark, source, str(tmp_path / target), add_scores, labels(spark)).orderBy("rank").collect()
    assert [(r.predicted_naics, r.n) for r in total] == [("11", 4), ("52", 4), ("62", 4)]
    assert total[0].mean_confidence == pytest.approx(np.exp(3) / (np.exp(3) + 2))
    stored = readers.read_repos(spark, str(tmp_path / target))
    assert stored.count() == 12 and "naics_description" in stored.columns


def test_null_text_is_scored_as_empty(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert cl.classify(add_scores(df), labels(spark)).first().predicted_naics == "11"


def test_pairs_keep_group(spark):
    rows = spark.createDataFrame([("test", 1, "bank")], "split string, label int, text string")
    assert [tuple(r) for r in pe.predicted_pairs(rows, add_scores, by=("split",)).collect()] == [("test", 1, 1)]


def test_unknown_split(spark):
    with pytest.raises(ValueError, match="not found"):
        pe.evaluate_split(repos(spark), add_scores, "holdout")


def test_whole_texts_are_read(spark):
    """The only signal stands after word 600 and after character 5,000."""
    same = " ".join(f"word{k % 50}" for k in range(900))
    rows = [(i, "11" if i % 2 else "62", f"{same} {'farm' if i % 2 else 'clinic'}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, code string, readme_content string")
    docs = docs.withColumn("name_repo", F.lit("r")).withColumn("description", F.lit(None).cast("string"))
    run = train_classifier(docs, min_samples=None, reg_params=(0.001,), n_features=1 << 10)
    assert all(r.accuracy == 1.0 for r in run.metrics.collect())
    out = ps.score_corpus(docs, lambda df: cl.score_with_model(df, run.model), run.labels)
    assert all(r.predicted_naics == r.code for r in out.collect())
    cut = ps.score_corpus(docs, lambda df: cl.score_with_model(df, run.model), run.labels, max_readme_chars=5000)
    assert len({r.predicted_naics for r in cut.collect()}) == 1


def test_external_scorer_sees_bounded_batches(spark, tmp_path):
    """Texts of similar length, few enough characters at a time, and the rows in their order."""
    from sectorscope.operators.classify import score_with, text_batches

    sizes = np.array([5, 0, 900, 5, 7, 3000, 5])
    parts = [sorted(sizes[p].tolist()) for p in text_batches(sizes, 3, 1000)]
    assert parts == [[0, 5, 5], [5, 7], [900], [3000]]
    log = str(tmp_path / "log")

    def opener():
        def score(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)} {max(map(len, texts))}\n")
            return [[float(len(t)), 0.0] for t in texts]

        return score

    texts = ["x" * (k % 50) for k in range(500)] + ["y" * 3_000_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = score_with(rows, opener, batch_size=64, max_chars=1000).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(texts[r["id"]] or "")
        assert r["probabilities"][0] == pytest.approx(1 / (1 + math.exp(-min(n, 700))))
    seen = [tuple(map(int, line.split())) for line in open(log)]
    assert all(n <= 64 and (n == 1 or n * longest <= 1000) for n, longest in seen)


def test_texts_are_cleaned_and_counted_once(spark, monkeypatch):
    """The fit reads stored counts only, and the training hands on its texts."""
    stored, store = [], cl.store

    def noted(df, name):
        stored.append((name, df.columns))
        return store(df, name)

    monkeypatch.setattr(cl, "store", noted)
    run = train_classifier(repos(spark), min_samples=10, reg_params=(0.001, 1.0), max_iter=2, n_features=256)
    assert stored == [("train-counts", ["label", "_counts"]), ("validation-counts", ["label", "_counts"])]
    rows = repos(spark)
    want = rows.select("id", corpus.training_text_column(rows).alias("text"))
    assert sorted(map(tuple, run.corpus.select("id", "text").collect())) == sorted(map(tuple, want.collect()))


def test_stored_model_scores_classes_left_out(spark, tmp_path):
    from bindings import scoring

    data = [(k, "aa bb cc" if k % 2 else "dd ee", "x" if k % 2 else "y", "s") for k in range(60)]
    data += [(60, "aa dd", "rare", "s"), (61, "ee", None, "s"), (62, None, "x", "s")]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, scoring.model_stored(spark, str(tmp_path)).collect()))
    assert found == [(k, True, True) for k in range(63)]
