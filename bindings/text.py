"""Text operators over documents."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import LOGITS_CTE, NOISY_REPOS_CTE, REPOS_CTE, logits, repos, sql_clean, sql_topics
from sectorscope.functions import text as tx
from sectorscope.operators import classify as cl
from sectorscope.operators import corpus, profile


@query(f"WITH {REPOS_CTE} SELECT id, {sql_topics('topics')} AS topics FROM repos")
def topics_normalized(spark, sf_dir):
    return corpus.normalize_topics(repos(spark, sf_dir)).select("id", "topics")


@query(f"WITH {REPOS_CTE} SELECT id, {sql_topics('topics')} AS topics FROM repos")
def topics_from_arrays(spark, sf_dir):
    stored = repos(spark, sf_dir)
    parts = F.split(tx.clean_topics(F.col("topics")), "; ")
    as_arrays = stored.withColumn("topics", F.concat(F.array(F.lit(""), F.lit(None).cast("string")), parts))
    return corpus.normalize_topics(as_arrays).select("id", "topics")


@query(f"WITH {NOISY_REPOS_CTE} SELECT id, {sql_clean('readme_content')} AS text FROM repos")
def readme_cleaned(spark, sf_dir):
    return repos(spark, sf_dir, noisy=True).select("id", tx.clean_readme(F.col("readme_content")).alias("text"))


@query(
    r"""SELECT doc_id AS id, array_to_string([w for w in regexp_split_to_array(text, '\s+') if w <> ''][1:50], ' ') AS words
    FROM documents"""
)
def readme_first_words(spark, sf_dir):
    return repos(spark, sf_dir).select("id", tx.first_words(F.col("readme_content"), 50).alias("words"))


def _labelled(name: str, value: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN '{name}: ' || {value} END"


def _joined(parts: list[str]) -> str:
    return f"array_to_string([p for p in [{', '.join(parts)}] if p IS NOT NULL], ' | ')"


_TRAIN_PARTS = [
    _labelled("Repository", "name_repo", "name_repo IS NOT NULL"),
    _labelled("Description", "description", "description IS NOT NULL"),
    _labelled("Topics", sql_topics("topics"), f"{sql_topics('topics')} <> ''"),
    _labelled("README", "readme_content", "readme_content IS NOT NULL"),
]


@query(f"WITH {NOISY_REPOS_CTE} SELECT id, {sql_clean(_joined(_TRAIN_PARTS))} AS text FROM repos")
def training_texts(spark, sf_dir):
    rows = corpus.normalize_topics(repos(spark, sf_dir, noisy=True))
    return rows.select("id", corpus.training_text_column(rows).alias("text"))


_SIMPLE_PARTS = [
    _labelled("Repository", "name_repo", "name_repo <> ''"),
    _labelled("Description", "description", "description <> ''"),
    _labelled("Topics", "topics", "topics <> ''"),
    _labelled("README", "readme_content", "readme_content <> ''"),
]
SIMPLE_TEXT_SQL = _joined(_SIMPLE_PARTS)


@query(f"WITH {NOISY_REPOS_CTE} SELECT id, {SIMPLE_TEXT_SQL} AS text FROM repos")
def simple_texts(spark, sf_dir):
    rows = repos(spark, sf_dir, noisy=True)
    return rows.select("id", corpus.simple_text_column(rows).alias("text"))


_BATCH_TOPICS = "replace(replace(replace(replace(topics, '[', ''), ']', ''), ',', ';'), '''', '')"
_BATCH_PARTS = [
    _labelled("Repository", "name_repo", "trim(name_repo) <> ''"),
    _labelled("Description", "description", "trim(description) <> '' AND description <> 'nan'"),
    _labelled("Topics", _BATCH_TOPICS, f"trim(topics) NOT IN ('', 'nan', '[]') AND trim({_BATCH_TOPICS}) <> ''"),
    _labelled("README", "substr(readme_content, 1, 5000)", "trim(readme_content) <> '' AND readme_content <> 'nan'"),
]
BATCH_TEXT_SQL = sql_clean(_joined(_BATCH_PARTS))
WHOLE_TEXT_SQL = BATCH_TEXT_SQL.replace("substr(readme_content, 1, 5000)", "readme_content")


@query(f"WITH {NOISY_REPOS_CTE} SELECT id, {BATCH_TEXT_SQL} AS text FROM repos")
def batch_texts(spark, sf_dir):
    rows = repos(spark, sf_dir, noisy=True)
    return rows.select("id", corpus.batch_text_column(rows).alias("text"))


@query("SELECT doc_id AS id, substr(text, 1, 5000) AS readme, length(substr(text, 1, 5000)) AS n FROM documents")
def readme_cut(spark, sf_dir):
    cut = tx.first_chars(F.col("readme_content"), 5000)
    return repos(spark, sf_dir).select("id", cut.alias("readme"), F.length(cut).cast("long").alias("n"))


@query(
    r"""WITH t AS (SELECT doc_id AS id, [w for w in regexp_split_to_array(lower(text), '\s+') if w <> ''][1:512] AS tokens FROM documents)
    SELECT id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INTEGER) AS n_tokens FROM t"""
)
def tokens_truncated(spark, sf_dir):
    rows = repos(spark, sf_dir).select("id", F.col("readme_content").alias("text"))
    words = cl.tokenize(rows, tx.token_limit(2048))
    return words.select("id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query("SELECT length(text) AS length, count(*) AS n FROM documents GROUP BY 1")
def text_lengths(spark, sf_dir):
    rows = repos(spark, sf_dir).select(F.col("readme_content").alias("text"))
    return profile.length_counts(rows).select(F.col("length").cast("long").alias("length"), "n")


@query(f"WITH {LOGITS_CTE} SELECT id, printf('%.2f%%', confidence * 100) AS confidence FROM guess")
def confidence_percent(spark, sf_dir):
    scored = cl.score_logits(logits(spark, sf_dir))
    return scored.select("id", tx.percent(F.array_max("probabilities")).alias("confidence"))
