import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from sectorscope.operators import evaluation as ev

TRUTH, GUESS = [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]


def counts(spark, truth=TRUTH, guess=GUESS):
    return ev.confusion_counts(spark.createDataFrame(list(zip(truth, guess)), "label int, prediction int"))


def test_averages(spark):
    rows = {r.average: r for r in ev.average_metrics(counts(spark), ("weighted", "macro", "micro")).collect()}
    w, m, u = rows["weighted"], rows["macro"], rows["micro"]
    assert (w.accuracy, round(w.precision, 6), w.recall, round(w.f1, 6)) == (0.6, 0.466667, 0.6, 0.52)
    assert (round(m.precision, 6), m.recall, round(m.f1, 6)) == (0.388889, 0.5, 0.433333)
    assert (u.precision, u.recall, u.f1) == (0.6, 0.6, 0.6)
    with pytest.raises(ValueError):
        ev.average_metrics(counts(spark), ("harmonic",))


def test_weighted_f1_equals_spark_ml(spark):
    truth = [i % 5 for i in range(200)]
    guess = [(i * 7 // 3) % 6 for i in range(200)]
    df = spark.createDataFrame([(float(t), float(g)) for t, g in zip(truth, guess)], "label double, prediction double")
    row = ev.metrics(counts(spark, truth, guess)).first()
    for name, got in (("f1", row.f1), ("weightedPrecision", row.precision), ("weightedRecall", row.recall), ("accuracy", row.accuracy)):
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(df) == pytest.approx(got, abs=1e-12)


def test_report(spark):
    labels = spark.createDataFrame([(0, "11"), (1, "21"), (2, "22")], "label int, code string")
    rows = {r["class"]: r for r in ev.classification_report(counts(spark), labels=labels).collect()}
    assert [round(rows[c].f1, 6) for c in ("11", "21", "22")] == [0.5, 0.8, 0.0]
    assert [rows[c].support for c in ("11", "21", "22")] == [2, 2, 1]
    assert rows["accuracy"].f1 == 0.6 and rows["accuracy"].precision is None and rows["accuracy"].support == 5
    assert round(rows["macro avg"].f1, 6) == 0.433333
    assert round(rows["weighted avg"].f1, 6) == 0.52


def test_report_order_is_numeric(spark):
    truth = list(range(12))
    report = ev.classification_report(counts(spark, truth, truth)).orderBy("seq")
    assert [r["class"] for r in report.collect()] == [str(i) for i in truth] + list(ev.SUMMARY_ROWS)


def test_ranking(spark):
    report = ev.classification_report(counts(spark, [0, 1, 2, 10], [0, 1, 0, 10]))
    assert [r["class"] for r in ev.class_ranking(report).collect()] == ["10", "1", "0", "2"]


@pytest.mark.parametrize("mode, group", [("true", "label"), ("pred", "prediction"), ("all", None)])
def test_normalized_matrix_sums_to_one(spark, mode, group):
    cells = ev.confusion_matrix(counts(spark), mode)
    assert cells.count() == 9
    sums = cells.groupBy(*([group] if group else [])).agg(F.sum("value").alias("s"))
    got = sorted(round(r.s, 9) for r in sums.collect())
    assert got == ([0.0, 1.0, 1.0] if mode == "pred" else [1.0, 1.0, 1.0] if group else [1.0])


def test_class_without_truth(spark):
    """0 in the normalized matrix, undefined in the heat map."""
    c = counts(spark, [0, 0], [0, 3])
    zero = {(r.label, r.prediction): r.value for r in ev.confusion_matrix(c, "true").collect()}
    null = {(r.label, r.prediction): r.value for r in ev.heatmap(c).collect()}
    assert zero[(3, 0)] == 0.0 and null[(3, 0)] is None
    assert zero[(0, 3)] == null[(0, 3)] == 0.5
    with pytest.raises(ValueError):
        ev.confusion_matrix(c, "rows")


@pytest.mark.parametrize(
    "val, test, status",
    [
        ((0.90, 0.80), (0.80, 0.80), "potential_overfitting"),
        ((0.90, 0.70), (0.80, 0.80), "unusual"),
        ((0.80, 0.80), (0.80, 0.80), "good"),
        ((0.70, 0.84), (0.80, 0.80), "unusual"),
        ((0.70, 0.90), (0.80, 0.80), "potential_overfitting"),
    ],
)
def test_gap(spark, val, test, status):
    rows = [("validation", *val), ("test", *test), ("train", 1.0, 1.0)]
    row = ev.generalization_gap(spark.createDataFrame(rows, "split string, f1 double, accuracy double")).first()
    assert row.status == status
    assert row.f1_gap == pytest.approx(val[0] - test[0])


def test_groups_in_one_pass(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 1, 1)], "split string, label int, prediction int")
    rows = {r.split: r.accuracy for r in ev.metrics(ev.confusion_counts(df, ["split"]), ["split"]).collect()}
    assert rows == {"a": 0.5, "b": 1.0}


def test_evaluation_with_the_labels_of_the_data(spark):
    from sectorscope.operators.classify import score_logits
    from sectorscope.plans.evaluate import evaluate_table

    rows = [(i, "62" if i % 2 else "11", "clinic" if i % 2 else "farm") for i in range(40)]
    repos = spark.createDataFrame(rows, "id long, code string, readme_content string")
    repos = repos.withColumn("name_repo", F.lit("r")).withColumn("description", F.lit(None).cast("string"))

    def add(df):
        return score_logits(df.withColumn("l", F.array(F.lit(0.5), F.contains("text", F.lit("clinic")).cast("double"))), "l")

    result = evaluate_table(repos, add)
    assert result.metrics.first().accuracy == 1.0
    assert {r["class"] for r in result.report.collect()} >= {"11", "62"}
