"""Scoring, ranking and classifier jobs."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import (
    DIM_CTE,
    LABEL_CTE,
    LOGITS_CTE,
    N_LOGITS,
    NOISY_REPOS_CTE,
    label_dim,
    logits,
    pair_prob_cte,
    pair_scorer,
    pair_scores,
    repos,
    split_cte,
    spread_documents,
    table,
)
from bindings.text import SIMPLE_TEXT_SQL, WHOLE_TEXT_SQL
from sectorscope.functions import scores as sc
from sectorscope.functions.codes import CLASS_CODES
from sectorscope.operators import classify as cl
from sectorscope.operators import corpus, summary
from sectorscope.operators.sizing import lookup_join
from sectorscope.plans import score as ps
from sectorscope.plans.train import train_classifier, train_words
from sectorscope.sources import writers
from sectorscope.sources.paths import shared_folder, store
from sectorscope.sources.writers import load_model

_NAMED = f"{LOGITS_CTE}, {LABEL_CTE}"


def scored_vectors(spark, sf_dir):
    return cl.score_logits(logits(spark, sf_dir))


def classified_vectors(spark, sf_dir):
    return cl.classify(scored_vectors(spark, sf_dir), label_dim(spark))


@query(
    f"""WITH {_NAMED} SELECT id, prediction AS class_index, code AS predicted_naics, round(confidence, 6) AS confidence
    FROM guess JOIN label_dim ON label_dim.label = prediction"""
)
def scored_logits(spark, sf_dir):
    rows = classified_vectors(spark, sf_dir)
    return rows.select("id", "class_index", "predicted_naics", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LOGITS_CTE} SELECT id, prediction AS class_index, round(confidence, 6) AS confidence FROM guess")
def best_class(spark, sf_dir):
    rows = scored_vectors(spark, sf_dir)
    return rows.select(
        "id", sc.argmax(F.col("probabilities")).alias("class_index"), F.round(F.array_max("probabilities"), 6).alias("confidence")
    )


@query(
    f"""WITH {_NAMED}, ranked AS (SELECT id, class_index, p, CAST(row_number() OVER (PARTITION BY id ORDER BY p DESC, class_index) AS INTEGER) AS rank FROM prob)
    SELECT id, rank, class_index, round(p, 6) AS score, code AS predicted_naics FROM ranked JOIN label_dim ON label_dim.label = class_index WHERE rank <= 3"""
)
def top_three_classes(spark, sf_dir):
    ranked = cl.top_classes(scored_vectors(spark, sf_dir), label_dim(spark), 3, ["id"])
    return ranked.withColumn("score", F.round("score", 6))


@query(f"WITH {_NAMED} SELECT id, code, round(p, 6) AS score FROM prob JOIN label_dim ON label_dim.label = class_index")
def all_class_scores(spark, sf_dir):
    rows = cl.all_scores(scored_vectors(spark, sf_dir), CLASS_CODES[:N_LOGITS])
    return rows.select("id", F.explode("all_scores").alias("code", "score")).withColumn("score", F.round("score", 6))


_DIST = "dist AS (SELECT code AS predicted_naics, count(*) AS n, sum(confidence) AS s FROM guess JOIN label_dim ON label_dim.label = prediction GROUP BY 1)"


@query(
    f"""WITH {_NAMED}, {_DIST}, {DIM_CTE}, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, predicted_naics) AS INTEGER) AS rank,
      CAST(sum(n) OVER () AS BIGINT) AS total, sum(s) OVER () / sum(n) OVER () AS mean_confidence FROM dist)
    SELECT total, round(mean_confidence, 6) AS mean_confidence, rank, predicted_naics, coalesce(medium_desc, 'Unknown') AS industry, n,
      round(100.0 * n / total, 6) AS pct FROM ranked LEFT JOIN dim ON dim.code = predicted_naics WHERE rank <= 10"""
)
def scoring_summary(spark, sf_dir):
    table_ = summary.scoring_summary(classified_vectors(spark, sf_dir))
    return table_.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "pct")})


@query(f"WITH {_NAMED}, {_DIST} SELECT predicted_naics, n FROM dist ORDER BY n DESC, predicted_naics")
def prediction_distribution(spark, sf_dir):
    return summary.prediction_distribution(classified_vectors(spark, sf_dir))


_TEXTS = f"{NOISY_REPOS_CTE}, texts AS (SELECT id, {WHOLE_TEXT_SQL} AS text FROM repos), {pair_prob_cte('texts')}, {LABEL_CTE}"
_SIMPLE = f"{NOISY_REPOS_CTE}, texts AS (SELECT id, {SIMPLE_TEXT_SQL} AS text FROM repos), {pair_prob_cte('texts')}, {LABEL_CTE}"


@query(
    f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {pair_prob_cte('docs')}, {LABEL_CTE}
    SELECT id, class_index, code AS predicted_naics, round(confidence, 6) AS confidence
    FROM pair_guess JOIN label_dim ON label = class_index"""
)
def external_scorer(spark, sf_dir):
    rows = spread_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    scored = cl.classify(cl.score_with(rows, pair_scorer()), label_dim(spark)).drop("text")
    return scored.withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_TEXTS}, {DIM_CTE} SELECT repos.id, repos.code, name_repo, description, topics, readme_content,
      label_dim.code AS predicted_naics, round(confidence, 6) AS confidence, coalesce(medium_desc, 'Unknown') AS naics_description
    FROM repos JOIN pair_guess USING (id) JOIN label_dim ON label = class_index LEFT JOIN dim ON dim.code = label_dim.code"""
)
def scored_corpus(spark, sf_dir):
    rows = ps.score_corpus(repos(spark, sf_dir, noisy=True), pair_scores, label_dim(spark))
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_SIMPLE}, {DIM_CTE} SELECT repos.id, name_repo, label_dim.code AS predicted_naics, round(confidence, 6) AS confidence,
      long_desc AS naics_description FROM repos JOIN pair_guess USING (id) JOIN label_dim ON label = class_index
    LEFT JOIN dim ON dim.code = label_dim.code"""
)
def predicted_table(spark, sf_dir):
    rows = ps.predict_table(repos(spark, sf_dir, noisy=True), pair_scores, label_dim(spark))
    return rows.select("id", "name_repo", "predicted_naics", F.round("confidence", 6).alias("confidence"), "naics_description")


@query(
    f"""WITH {_SIMPLE}, {DIM_CTE} SELECT repos.id, label_dim.code AS naics_code, long_desc AS industry,
      printf('%.2f%%', confidence * 100) AS confidence FROM repos JOIN pair_guess USING (id) JOIN label_dim ON label = class_index
    LEFT JOIN dim ON dim.code = label_dim.code"""
)
def classified_repositories(spark, sf_dir):
    rows = ps.classify_repositories(repos(spark, sf_dir, noisy=True), pair_scores, label_dim(spark))
    return rows.select("id", "naics_code", "industry", "confidence")


@query(
    f"""WITH {_SIMPLE}, {DIM_CTE} SELECT name_repo, label_dim.code AS predicted_naics, round(confidence, 6) AS confidence,
      long_desc AS naics_description FROM repos JOIN pair_guess USING (id) JOIN label_dim ON label = class_index
    LEFT JOIN dim ON dim.code = label_dim.code ORDER BY name_repo LIMIT 10"""
)
def sample_predictions(spark, sf_dir):
    """The ten rows are chosen before they are scored."""
    chosen = corpus.take_rows(repos(spark, sf_dir, noisy=True), 10, "name_repo")
    rows = ps.predict_table(chosen, pair_scores, label_dim(spark))
    return summary.sample_preview(rows, 10, "name_repo").withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {pair_prob_cte('docs')}, {LABEL_CTE}
    SELECT id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text, code AS predicted_naics,
      round(confidence, 6) AS confidence FROM docs JOIN pair_guess USING (id) JOIN label_dim ON label = class_index"""
)
def text_previews(spark, sf_dir):
    rows = spread_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    scored = cl.classify(pair_scores(rows), label_dim(spark)).withColumn("confidence", F.round("confidence", 6))
    return summary.text_preview(scored).drop("class_index")


# --- training: which language is a document written in -----------------------------------------
# SQL has no classifier: it states what a good one must show, and the queries say whether it does.
FLOOR = 0.8


def language_repos(spark, sf_dir):
    """Documents as repositories whose class is their language; nothing but the text tells it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("code"), F.col("source").alias("name_repo"), F.col("text").alias("readme_content")
    )


def trained(spark, sf_dir, **kwargs):
    settings = {"min_samples": 10, "reg_params": (0.01,), "max_iter": 10, "n_features": 1 << 14}
    return train_classifier(language_repos(spark, sf_dir), **{**settings, **kwargs})


def model_texts(spark, sf_dir, run):
    """``id`` and ``text`` of all documents, stored: texts the training has cleaned are not cleaned again."""
    rows = language_repos(spark, sf_dir)
    left_out = lookup_join(rows, run.labels.select("code"), "code", "left_anti")
    others = store(left_out.select("id", corpus.training_text_column(left_out).alias("text")), "other-texts")
    return run.corpus.select("id", "text").unionByName(others)


def with_model(texts, model, labels):
    return cl.classify(cl.score_with_model(texts, model), labels)


_LANGUAGES = "src AS (SELECT doc_id AS id, lang AS label FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 10))"


@query(
    f"""WITH {_LANGUAGES}, {split_cte('src')} SELECT split, count(*) AS n_rows, true AS accurate, true AS f1_above_floor
    FROM split WHERE split <> 'train' GROUP BY split"""
)
def training_job(spark, sf_dir):
    """Prepare, split, fit a small grid, keep the best by validation F1; sizes and quality of the held-out splits."""
    run = trained(spark, sf_dir, reg_params=(0.001, 0.1))
    rows = run.metrics.join(run.sizes, "split")
    return rows.select("split", "n_rows", (F.col("accuracy") > FLOOR).alias("accurate"), (F.col("f1") > FLOOR).alias("f1_above_floor"))


# --- a model that SQL repeats: a weight for every word and language, and an offset for each language -
STEPS, RATE, PENALTY = 4, 2.0, 0.01


def word_model(spark, sf_dir):
    rows = language_repos(spark, sf_dir).select("id", "code", F.col("readme_content").alias("text"))
    frequent = corpus.keep_frequent_classes(rows, "code", 10)
    labels = corpus.label_dim(frequent)
    return train_words(corpus.attach_label(frequent, labels), labels, steps=STEPS, rate=RATE, penalty=PENALTY)


def _word_model_ctes() -> str:
    ctes = [
        _LANGUAGES,
        split_cte("src"),
        "kinds AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT label FROM src))",
        r"words AS (SELECT doc_id AS id, unnest([w for w in regexp_split_to_array(lower(text), '\s+') if w <> '']) AS word FROM documents)",
        "counts AS (SELECT word, label, count(*) AS c, count(DISTINCT id) AS d FROM words JOIN split USING (id) WHERE split = 'train' GROUP BY 1, 2)",
        "vocabulary AS (SELECT word, sum(d) AS d FROM counts GROUP BY 1)",
        "totals AS (SELECT kinds.label, coalesce(sum(c), 0) + (SELECT count(*) FROM vocabulary) AS t FROM kinds LEFT JOIN counts USING (label) GROUP BY 1)",
        """weights AS (SELECT word, label, ln(((SELECT count(*) FROM split WHERE split = 'train') + 1e0) / (vocabulary.d + 1e0)) * ln((coalesce(c, 0) + 1e0) / t) AS w
      FROM vocabulary CROSS JOIN totals LEFT JOIN counts USING (word, label))""",
        "means AS (SELECT id, label, avg(w) AS z FROM words JOIN weights USING (word) GROUP BY 1, 2)",
        """logits AS (SELECT doc_id AS id, kinds.label, k, coalesce(z, 0e0) AS z FROM documents CROSS JOIN kinds
      LEFT JOIN means ON means.id = doc_id AND means.label = kinds.label)""",
        "held AS (SELECT l.*, split.label AS truth FROM logits l JOIN split USING (id) WHERE split = 'validation')",
        "offset_0 AS (SELECT label, 0e0 AS b FROM kinds)",
    ]
    for step in range(STEPS + 1):
        ctes.append(
            f"""p_{step} AS (SELECT id, label, truth, b, exp(z + b) / sum(exp(z + b)) OVER (PARTITION BY id) AS p
      FROM held JOIN offset_{step} USING (label))"""
        )
        if step < STEPS:
            ctes.append(
                f"""offset_{step + 1} AS (SELECT label, any_value(b) - {RATE}e0 * (avg(p - CASE WHEN label = truth THEN 1e0 ELSE 0e0 END)
      + {PENALTY}e0 * any_value(b)) AS b FROM p_{step} GROUP BY label)"""
            )
    return ", ".join(ctes)


def _loss_sql(step: int) -> str:
    return f"""SELECT CAST({step} AS INTEGER) AS step, 'loss' AS metric, round((SELECT avg(-ln(p)) FROM p_{step} WHERE label = truth)
      + {PENALTY / 2}e0 * (SELECT sum(b * b) FROM offset_{step}), 9) AS value"""


@query(f"WITH {_word_model_ctes()} " + " UNION ALL ".join(_loss_sql(step) for step in range(STEPS + 1)))
def training_curve(spark, sf_dir):
    """Log loss plus penalty of every step of the offsets' fit."""
    return word_model(spark, sf_dir).curve.withColumn("value", F.round("value", 9))


@query(
    f"""WITH {_word_model_ctes()}, shown AS (SELECT id, label, k, exp(z + b) / sum(exp(z + b)) OVER (PARTITION BY id) AS p
      FROM logits JOIN offset_{STEPS} USING (label)),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS place FROM shown)
    SELECT id, k AS class_index, label AS predicted_naics, round(p, 6) AS confidence FROM best WHERE place = 1"""
)
def model_predictions(spark, sf_dir):
    """Classify the whole table with the fitted table of weights: class and confidence."""
    model = word_model(spark, sf_dir)
    rows = language_repos(spark, sf_dir).select("id", F.col("readme_content").alias("text"))
    scored = cl.classify(model.score(rows), model.labels)
    return scored.select("id", "class_index", "predicted_naics", F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id AS id, true AS same_class, true AS same_confidence FROM documents")
def model_stored(spark, sf_dir):
    """The model read back from its folder, with its label map, against the fitted one."""
    folder = shared_folder(spark, "model")
    run = trained(spark, sf_dir, save_to=folder)
    model, labels = load_model(spark, folder)
    texts = model_texts(spark, sf_dir, run)
    own = with_model(texts, run.model, run.labels).select("id", F.col("predicted_naics").alias("a"), F.col("confidence").alias("x"))
    back = with_model(texts, model, labels).select("id", F.col("predicted_naics").alias("b"), F.col("confidence").alias("y"))
    return own.join(back, "id").select(
        "id", (F.col("a") == F.col("b")).alias("same_class"), (F.col("x") == F.col("y")).alias("same_confidence")
    )


# --- whole jobs over files ------------------------------------------------------------------------
@query(
    f"""WITH {_SIMPLE} SELECT label_dim.code AS predicted_naics, count(*) AS n FROM repos JOIN pair_guess USING (id)
    JOIN label_dim ON label = class_index GROUP BY 1"""
)
def prediction_file_job(spark, sf_dir):
    """Read by suffix, score the simple layout, write by suffix, count classes of the written file."""
    folder = shared_folder(spark, "prediction")
    writers.write_csv(repos(spark, sf_dir, noisy=True), f"{folder}/in.csv")
    return ps.predict_file(spark, f"{folder}/in.csv", f"{folder}/out.json", pair_scores, label_dim(spark))


@query(
    f"""WITH {_TEXTS}, {DIM_CTE}, guess AS (SELECT code AS predicted_naics, confidence FROM pair_guess JOIN label_dim ON label = class_index),
    dist AS (SELECT predicted_naics, count(*) AS n, sum(confidence) AS s FROM guess GROUP BY 1),
    ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, predicted_naics) AS INTEGER) AS rank,
      CAST(sum(n) OVER () AS BIGINT) AS total, sum(s) OVER () / sum(n) OVER () AS mean_confidence FROM dist)
    SELECT total, round(mean_confidence, 6) AS mean_confidence, rank, predicted_naics, coalesce(medium_desc, 'Unknown') AS industry, n,
      round(100.0 * n / total, 6) AS pct FROM ranked LEFT JOIN dim ON dim.code = predicted_naics WHERE rank <= 10"""
)
def scoring_file_job(spark, sf_dir):
    """Score a Parquet table in the batch layout into CSV; the summary comes from the written file."""
    folder = shared_folder(spark, "scoring")
    repos(spark, sf_dir, noisy=True).write.parquet(f"{folder}/in.parquet")
    result = ps.score_file(spark, f"{folder}/in.parquet", f"{folder}/out.csv", pair_scores, label_dim(spark))
    return result.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "pct")})
