"""Evaluation over embeddings: truth is the label, the prediction comes from folded logits."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import (
    LABEL_CTE,
    LOGITS_CTE,
    REPOS_CTE,
    label_dim,
    logits,
    pair_prob_cte,
    pair_scores,
    repos,
    split_cte,
    sql_clean,
)
from bindings.text import _TRAIN_PARTS, _joined
from sectorscope.operators import classify as cl
from sectorscope.operators import evaluation as ev
from sectorscope.operators.split import stratified_split
from sectorscope.plans.evaluate import evaluate_counts, evaluate_split, evaluate_table, predicted_pairs

DIGITS = 6


def pairs(spark, sf_dir):
    return predicted_pairs(logits(spark, sf_dir), cl.score_logits)


def counts(spark, sf_dir):
    return ev.confusion_counts(pairs(spark, sf_dir))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


PAIRS_CTE = f"{LOGITS_CTE}, pairs AS (SELECT label, prediction FROM guess)"


def metric_ctes(by: str = "", pairs_cte: str = PAIRS_CTE) -> str:
    """Per class and overall metrics in SQL; ``by`` is an optional grouping column."""
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    over = f"PARTITION BY {by}" if by else ""
    return f"""{pairs_cte},
    seen AS (SELECT {b}label AS class_id, 1 AS support, 0 AS predicted, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM pairs
      UNION ALL SELECT {b}prediction, 0, 1, 0 FROM pairs),
    per AS (SELECT {b}class_id, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp
      FROM seen GROUP BY {b}class_id),
    cls AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted END AS precision,
      CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS recall,
      CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (predicted + support) END AS f1 FROM per),
    avgs AS (SELECT {b}sum(tp)::DOUBLE / sum(support) AS accuracy, CAST(sum(support) AS BIGINT) AS total,
      avg(precision) AS macro_p, avg(recall) AS macro_r, avg(f1) AS macro_f,
      sum(precision * support) / sum(support) AS weighted_p, sum(recall * support) / sum(support) AS weighted_r,
      sum(f1 * support) / sum(support) AS weighted_f FROM cls {g})"""


@query(f"WITH {PAIRS_CTE} SELECT label, prediction FROM pairs")
def truth_and_prediction(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"WITH {PAIRS_CTE} SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query(
    f"""WITH {metric_ctes()} SELECT round(weighted_f, 6) AS f1, round(accuracy, 6) AS accuracy,
    round(weighted_p, 6) AS precision, round(weighted_r, 6) AS recall FROM avgs"""
)
def weighted_metrics(spark, sf_dir):
    return rounded(ev.metrics(counts(spark, sf_dir)), "f1", "accuracy", "precision", "recall")


@query(
    f"""WITH {metric_ctes()}, rows AS (
    SELECT 'weighted' AS average, accuracy, weighted_p AS precision, weighted_r AS recall, weighted_f AS f1 FROM avgs
    UNION ALL SELECT 'macro', accuracy, macro_p, macro_r, macro_f FROM avgs
    UNION ALL SELECT 'micro', accuracy, accuracy, accuracy, accuracy FROM avgs)
    SELECT average, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rows"""
)
def averaged_metrics(spark, sf_dir):
    table = ev.average_metrics(counts(spark, sf_dir), ("weighted", "macro", "micro"))
    return rounded(table, "f1", "accuracy", "precision", "recall")


REPORT_SQL = """SELECT coalesce(code, CAST(class_id AS VARCHAR)) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support FROM cls LEFT JOIN label_dim ON label = class_id
    UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), total FROM avgs
    UNION ALL SELECT 'macro avg', round(macro_p, 6), round(macro_r, 6), round(macro_f, 6), total FROM avgs
    UNION ALL SELECT 'weighted avg', round(weighted_p, 6), round(weighted_r, 6), round(weighted_f, 6), total FROM avgs"""


def report(cells, labels):
    return rounded(ev.classification_report(cells, labels=labels), "precision", "recall", "f1").drop("seq")


@query(f"WITH {metric_ctes()}, {LABEL_CTE} {REPORT_SQL}")
def class_report(spark, sf_dir):
    return report(counts(spark, sf_dir), label_dim(spark))


@query(
    f"""WITH {metric_ctes()}, {LABEL_CTE} SELECT coalesce(code, CAST(class_id AS VARCHAR)) AS class, round(f1, 6) AS f1
    FROM cls LEFT JOIN label_dim ON label = class_id ORDER BY f1 DESC, class DESC"""
)
def classes_by_f1(spark, sf_dir):
    ranking = ev.class_ranking(ev.classification_report(counts(spark, sf_dir), labels=label_dim(spark)))
    return rounded(ranking, "f1")


_CELLS = f"""{PAIRS_CTE}, ids AS (SELECT DISTINCT label AS i FROM pairs UNION SELECT DISTINCT prediction FROM pairs),
filled AS (SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2),
cells AS (SELECT a.i AS label, b.i AS prediction, coalesce(n, 0) AS n FROM ids a CROSS JOIN ids b
  LEFT JOIN filled f ON f.label = a.i AND f.prediction = b.i)"""


def _value(over: str) -> str:
    return f"CASE WHEN sum(n) OVER ({over}) = 0 THEN 0 ELSE round(n::DOUBLE / sum(n) OVER ({over}), 6) END AS value"


@query(f"WITH {_CELLS} SELECT label, prediction, n FROM cells")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(counts(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT label, prediction, n, {_value('PARTITION BY label')} FROM cells")
def confusion_by_truth(spark, sf_dir):
    return rounded(ev.confusion_matrix(counts(spark, sf_dir), "true"), "value")


@query(f"WITH {_CELLS} SELECT label, prediction, n, {_value('PARTITION BY prediction')} FROM cells")
def confusion_by_prediction(spark, sf_dir):
    return rounded(ev.confusion_matrix(counts(spark, sf_dir), "pred"), "value")


@query(f"WITH {_CELLS} SELECT label, prediction, n, {_value('')} FROM cells")
def confusion_by_total(spark, sf_dir):
    return rounded(ev.confusion_matrix(counts(spark, sf_dir), "all"), "value")


@query(
    f"""WITH {_CELLS} SELECT label, prediction, n, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY label), 0), 6) AS value FROM cells"""
)
def confusion_heatmap(spark, sf_dir):
    return rounded(ev.heatmap(counts(spark, sf_dir)), "value")


# --- on splits -------------------------------------------------------------------------------
def split_counts(spark, sf_dir):
    """Confusion counts per split from one pass over the scored rows."""
    rows = stratified_split(logits(spark, sf_dir))
    return ev.confusion_counts(predicted_pairs(rows, cl.score_logits, by=("split",)), ["split"])


_SPLIT_PAIRS = f"{LOGITS_CTE}, {split_cte('guess')}, pairs AS (SELECT split, label, prediction FROM split)"
_SPLIT_METRICS = metric_ctes("split", _SPLIT_PAIRS)


@query(
    f"""WITH {_SPLIT_METRICS} SELECT split, round(weighted_f, 6) AS f1, round(accuracy, 6) AS accuracy,
    round(weighted_p, 6) AS precision, round(weighted_r, 6) AS recall FROM avgs"""
)
def metrics_by_split(spark, sf_dir):
    return rounded(ev.metrics(split_counts(spark, sf_dir), ["split"]), "f1", "accuracy", "precision", "recall")


@query(
    f"""WITH {_SPLIT_METRICS} SELECT round(weighted_f, 6) AS f1, round(accuracy, 6) AS accuracy,
    round(weighted_p, 6) AS precision, round(weighted_r, 6) AS recall FROM avgs WHERE split = 'test'"""
)
def metrics_of_test(spark, sf_dir):
    rows = stratified_split(logits(spark, sf_dir))
    return rounded(evaluate_split(rows, cl.score_logits, "test"), "f1", "accuracy", "precision", "recall")


@query(
    f"""WITH {_SPLIT_METRICS}, gap AS (SELECT
      (SELECT weighted_f FROM avgs WHERE split = 'validation') - (SELECT weighted_f FROM avgs WHERE split = 'test') AS f,
      (SELECT accuracy FROM avgs WHERE split = 'validation') - (SELECT accuracy FROM avgs WHERE split = 'test') AS a)
    SELECT round(f, 6) AS f1_gap, round(a, 6) AS accuracy_gap, CASE WHEN a > 0.05 THEN 'potential_overfitting' WHEN a < -0.05 THEN 'unusual'
      WHEN f > 0.05 THEN 'potential_overfitting' WHEN f < -0.05 THEN 'unusual' ELSE 'good' END AS status FROM gap"""
)
def generalization_gap(spark, sf_dir):
    gap = ev.generalization_gap(ev.metrics(split_counts(spark, sf_dir), ["split"]))
    return rounded(gap, "f1_gap", "accuracy_gap")


_TEST_METRICS = metric_ctes("", f"{LOGITS_CTE}, {split_cte('guess')}, pairs AS (SELECT label, prediction FROM split WHERE split = 'test')")


@query(f"WITH {_TEST_METRICS}, {LABEL_CTE} {REPORT_SQL}")
def evaluation_job(spark, sf_dir):
    """Split, score the test part, derive every evaluation table; the class report is shown."""
    rows = stratified_split(logits(spark, sf_dir)).where(F.col("split") == "test")
    tables = evaluate_counts(ev.confusion_counts(predicted_pairs(rows, cl.score_logits)), label_dim(spark))
    return rounded(tables.report, "precision", "recall", "f1").drop("seq")


# The whole chain over documents: prepare, split by class, score the test texts, report.
_TEXT_PAIRS = f"""{REPOS_CTE}, {LABEL_CTE},
src AS (SELECT id, label, {sql_clean(_joined(_TRAIN_PARTS))} AS text FROM repos JOIN label_dim USING (code)),
{split_cte('src')}, held_out AS (SELECT * FROM split WHERE split = 'test'), {pair_prob_cte('held_out')},
pairs AS (SELECT label, class_index AS prediction FROM held_out JOIN pair_guess USING (id))"""


@query(f"WITH {metric_ctes('', _TEXT_PAIRS)} {REPORT_SQL}")
def text_evaluation_job(spark, sf_dir):
    tables = evaluate_table(repos(spark, sf_dir), pair_scores, label_dim(spark))
    return rounded(tables.report, "precision", "recall", "f1").drop("seq")
