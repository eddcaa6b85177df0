"""Curation, label ids, split and profiles over documents."""

from functools import lru_cache

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import (
    LABEL_CTE,
    NOISY_REPOS_CTE,
    REPOS_CTE,
    label_dim,
    repos,
    split_cte,
    sql_clean,
    table,
)
from bindings.text import _TRAIN_PARTS, _joined
from sectorscope.operators import classify as cl
from sectorscope.operators import corpus, profile
from sectorscope.operators.split import stratified_split
from sectorscope.plans.prepare import prepare_corpus

# Documents that have a quality label, by length in thousands: classes from common to rare.
MIN_SAMPLES = 20


def judged(spark, sf_dir):
    """Documents with their quality label; null where a document has none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(labels, "doc_id", "left")


def judged_classes(spark, sf_dir):
    size_class = F.floor(F.col("n_chars") / 1000).cast("string")
    rows = judged(spark, sf_dir).where(F.col("quality").isNotNull())
    return rows.select(F.col("doc_id").alias("id"), size_class.alias("code"))


_JUDGED = "judged AS (SELECT d.doc_id, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
_SOURCES = f"""{_JUDGED}, src AS (SELECT doc_id AS id, CAST(n_chars // 1000 AS VARCHAR) AS code
  FROM judged WHERE quality IS NOT NULL)"""
_COUNTS = f"{_SOURCES}, n AS (SELECT code, count(*) AS n FROM src GROUP BY 1)"


@query(f"WITH {_JUDGED} SELECT doc_id, source, n_chars, CAST(quality AS VARCHAR) AS quality FROM judged WHERE quality IS NOT NULL")
def target_present(spark, sf_dir):
    return corpus.drop_null_target(judged(spark, sf_dir), "quality")


@query(f"WITH {_COUNTS} SELECT code, n FROM n")
def class_counts(spark, sf_dir):
    return corpus.class_counts(judged_classes(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT code, n FROM n WHERE n < {MIN_SAMPLES}")
def excluded_classes(spark, sf_dir):
    return corpus.excluded_classes(judged_classes(spark, sf_dir), "code", MIN_SAMPLES)


@query(f"WITH {_COUNTS} SELECT id, code FROM src WHERE code IN (SELECT code FROM n WHERE n >= {MIN_SAMPLES})")
def frequent_class_rows(spark, sf_dir):
    return corpus.keep_frequent_classes(judged_classes(spark, sf_dir), "code", MIN_SAMPLES)


@query(
    f"""WITH {_JUDGED}, n AS (SELECT CAST(quality AS VARCHAR) AS code, count(*) AS n FROM judged GROUP BY 1)
    SELECT 0 AS seq, 'original' AS stage, CAST(sum(n) AS BIGINT) AS n_rows, count(code) AS n_classes FROM n
    UNION ALL SELECT 1, 'target_present', CAST(sum(n) AS BIGINT), count(code) FROM n WHERE code IS NOT NULL
    UNION ALL SELECT 2, 'class_filter', CAST(coalesce(sum(n), 0) AS BIGINT), count(code) FROM n WHERE code IS NOT NULL AND n >= 100"""
)
def filter_stages(spark, sf_dir):
    return corpus.filter_report(judged(spark, sf_dir), "quality", 100)


_LABELS = "known AS (SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS label, code FROM (SELECT DISTINCT code FROM repos))"


@query(f"WITH {REPOS_CTE}, {_LABELS} SELECT label, code FROM known")
def label_ids(spark, sf_dir):
    return corpus.label_dim(repos(spark, sf_dir))


@query(f"WITH {REPOS_CTE}, {_LABELS} SELECT id, repos.code, label FROM repos JOIN known USING (code)")
def label_lookup(spark, sf_dir):
    rows = repos(spark, sf_dir).select("id", "code")
    return corpus.attach_label(rows, corpus.label_dim(rows)).select("id", "code", "label")


@query(
    f"""WITH {LABEL_CTE}, ids AS (SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN lang ELSE CAST(n_chars % 25 AS VARCHAR) END AS class_index
    FROM documents) SELECT id, class_index, coalesce(code, class_index) AS predicted_naics
    FROM ids LEFT JOIN label_dim ON CAST(label AS VARCHAR) = class_index"""
)
def code_lookup(spark, sf_dir):
    raw = F.when(F.col("n_chars") % 3 == 0, F.col("lang")).otherwise((F.col("n_chars") % 25).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), raw.alias("class_index"))
    return corpus.attach_code(rows, label_dim(spark))


_TRAIN_TEXT = sql_clean(_joined(_TRAIN_PARTS))


@query(
    f"""WITH {NOISY_REPOS_CTE}, {_LABELS} SELECT id, {_TRAIN_TEXT} AS text, label FROM repos JOIN known USING (code)"""
)
def prepared_corpus(spark, sf_dir):
    rows, _ = prepare_corpus(repos(spark, sf_dir, noisy=True), min_samples=2, keep=["id"])
    return rows


@query(
    f"""WITH {REPOS_CTE}, {_LABELS}, words AS (SELECT id, [w for w in regexp_split_to_array(lower({_joined(_TRAIN_PARTS)}), '\\s+')
    if w <> ''] AS tokens, label AS labels FROM repos JOIN known USING (code))
    SELECT id, labels, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS token_hash FROM words"""
)
def training_columns(spark, sf_dir):
    rows, _ = prepare_corpus(repos(spark, sf_dir), clean=False, keep=["id"])
    words = cl.tokenize(rows)
    return words.select(
        "id", "labels", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("token_hash")
    )


_LIMIT = 25


@query(f"SELECT doc_id AS id, lang AS description FROM documents ORDER BY doc_id LIMIT {_LIMIT}")
def limited_rows(spark, sf_dir):
    return corpus.take_rows(repos(spark, sf_dir).select("id", "description"), _LIMIT, "id")


# --- split ---------------------------------------------------------------------------------
@query(f"WITH {REPOS_CTE}, {split_cte('repos', 'code')} SELECT id, code, split FROM split")
def stratified_rows(spark, sf_dir):
    return stratified_split(repos(spark, sf_dir).select("id", "code"), "code", "id")


@query(
    f"""WITH vec AS (SELECT vec_id AS id, label FROM embeddings), {split_cte('vec')}
    SELECT label, split, count(*) AS n FROM split GROUP BY 1, 2"""
)
def stratified_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return stratified_split(rows).groupBy("label", "split").agg(F.count("*").alias("n"))


# --- profiles --------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _lengths(spark, sf_dir, application):
    return profile.store_length_counts(table(spark, sf_dir, "documents"))


def lengths(spark, sf_dir):
    """One stored table for the five profiles: the texts are read once."""
    return _lengths(spark, sf_dir, spark.sparkContext.applicationId)


@query("SELECT CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, round(avg(length(text)), 6) AS mean_length FROM documents")
def length_range(spark, sf_dir):
    return profile.length_range(lengths(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6))


@query(
    """SELECT CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length,
    round(avg(length(text)), 6) AS mean_length, quantile_cont(length(text), 0.5) AS median_length,
    round(stddev_samp(length(text)), 4) AS std_length FROM documents"""
)
def length_stats(spark, sf_dir):
    stats = profile.length_stats(lengths(spark, sf_dir))
    return stats.withColumn("mean_length", F.round("mean_length", 6)).withColumn("std_length", F.round("std_length", 4))


@query(
    """WITH len AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents),
    r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 50 AS step FROM len),
    bins AS (SELECT CAST(range AS INTEGER) AS bin, lo + (range - 1) * step AS lower,
      CASE WHEN range = 50 THEN hi ELSE lo + range * step END AS upper FROM range(1, 51), r)
    SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
      count(x) AS n FROM bins LEFT JOIN len ON x >= lower AND (x < upper OR (bin = 50 AND x <= upper)) GROUP BY 1, 2, 3"""
)
def length_histogram(spark, sf_dir):
    bins = profile.length_histogram(lengths(spark, sf_dir))
    return bins.withColumn("lower", F.round("lower", 6)).withColumn("upper", F.round("upper", 6))


_BOX = """len AS (SELECT length(text) AS x FROM documents),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM len),
fence AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"""


@query(
    f"""WITH {_BOX} SELECT q1, median, q3, CAST(least(min(x) FILTER (WHERE x >= low), q1) AS DOUBLE) AS whisker_low,
    CAST(greatest(max(x) FILTER (WHERE x <= high), q3) AS DOUBLE) AS whisker_high,
    count(*) FILTER (WHERE x < low OR x > high) AS n_outliers FROM len, fence GROUP BY q1, median, q3"""
)
def length_box(spark, sf_dir):
    return profile.box_numbers(lengths(spark, sf_dir))


@query(f"WITH {_BOX} SELECT CAST(x AS INTEGER) AS length, count(*) AS n FROM len, fence WHERE x < low OR x > high GROUP BY 1")
def length_outliers(spark, sf_dir):
    return profile.outliers(lengths(spark, sf_dir))


@query(
    f"""WITH {_COUNTS} SELECT code, n, round(100.0 * n / sum(n) OVER (), 6) AS share_pct FROM n ORDER BY code"""
)
def class_distribution(spark, sf_dir):
    return profile.class_distribution(judged_classes(spark, sf_dir), "code").withColumn(
        "share_pct", F.round("share_pct", 6)
    )


@query(f"WITH {_COUNTS} SELECT count(*) AS n_classes, min(n) AS smallest, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total FROM n")
def class_range(spark, sf_dir):
    return profile.class_range(judged_classes(spark, sf_dir), "code")
