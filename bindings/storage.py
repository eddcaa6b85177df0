"""Sources and sinks: tables derived from the given ones are written to the shared folder and read back."""


from pyspark.sql import functions as F

from bindings.adoption import first_use
from bindings.evaluation import REPORT_SQL, counts, metric_ctes, rounded
from bindings.registry import query
from bindings.scoring import _NAMED, classified_vectors
from bindings.tables import LABEL_CTE, REPOS_CTE, FIRST_USE_CTE, label_dim, repos, table
from sectorscope.operators import adoption as ad
from sectorscope.operators import corpus
from sectorscope.plans.evaluate import evaluate_counts
from sectorscope.sources import readers, writers
from sectorscope.sources.paths import shared_folder, store


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def parquet_scan(spark, sf_dir):
    return readers.read_repos(spark, f"{sf_dir}/documents.parquet")


@query(
    f"""WITH {REPOS_CTE} SELECT id, code, name_repo, '  ' || description || chr(9) AS description, topics,
    chr(10) || ' ' || readme_content || ' ' || chr(10) AS readme_content FROM repos"""
)
def csv_scan(spark, sf_dir):
    """Texts with outer blanks, in a file whose columns stand in another order than the schema's."""
    path = shared_folder(spark, "repos") + ".csv"
    rows = repos(spark, sf_dir).withColumns(
        {
            "description": F.concat(F.lit("  "), "description", F.lit("\t")),
            "readme_content": F.concat(F.lit("\n "), "readme_content", F.lit(" \n")),
        }
    )
    writers.write_csv(rows.select("readme_content", "topics", "id", "description", "name_repo", "code"), path)
    return readers.read_repos(spark, path, f"id bigint, {readers.REPO_SCHEMA}")


@query("SELECT user_id AS nwo, min(ts) AS first_use_date FROM events GROUP BY 1")
def json_event_scan(spark, sf_dir):
    path = shared_folder(spark, "events") + ".json"
    events = table(spark, sf_dir, "events")
    lines = events.select(
        F.col("user_id").cast("string").alias("repo_nwo"), F.col("ts").cast("timestamp").alias("created_at"), "event_type", "props"
    )
    lines.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    found = ad.first_use(readers.read_events(spark, path))
    return found.select(F.col("nwo").cast("long").alias("nwo"), F.col("first_use_date").cast("timestamp_ntz").alias("first_use_date"))


# Every fifth line is cut off, and every seventh one has a time that cannot be read.
_BROKEN = "event_id % 5 = 0 OR event_id % 7 = 0"


@query(
    f"""SELECT user_id AS nwo, min(CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE ts END) AS first_use_date,
      (SELECT count(*) FROM events) AS n_lines, (SELECT count(*) FROM events WHERE {_BROKEN}) AS n_broken
    FROM events WHERE event_id % 5 <> 0 GROUP BY 1"""
)
def lenient_event_scan(spark, sf_dir):
    """First use from event lines of which some are broken, and the number of those, in one pass."""
    path = shared_folder(spark, "events") + ".json"
    events = table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 7 == 0, F.lit("soon")).otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("repo_nwo"), time.alias("created_at")))
    cut = F.when(F.col("event_id") % 5 == 0, F.left(line, F.lit(9))).otherwise(line)
    events.select(cut.alias("value")).write.text(path)
    rows, seen = readers.observed_events(spark, path)
    found = store(ad.first_use(rows), "first-use")
    return found.select(
        F.col("nwo").cast("long").alias("nwo"),
        F.col("first_use_date").cast("timestamp_ntz").alias("first_use_date"),
        F.lit(seen.get["n_lines"]).cast("long").alias("n_lines"),
        F.lit(seen.get["n_broken"]).cast("long").alias("n_broken"),
    )


@query(f"WITH {REPOS_CTE} SELECT id, name_repo AS name, readme_content AS readme FROM repos")
def column_aliases(spark, sf_dir):
    return readers.resolve_repo_columns(repos(spark, sf_dir)).select("id", "name", "readme")


def _stored_scores(spark, sf_dir, kind):
    path = shared_folder(spark, "scored") + f".{kind}"
    scored = classified_vectors(spark, sf_dir).select("id", "predicted_naics", F.round("confidence", 6).alias("confidence"))
    writers.write_scored(scored, path)
    reader = spark.read.schema(scored.schema)
    if kind == "json":
        return reader.json(path)
    return reader.parquet(path) if kind == "parquet" else reader.option("header", True).csv(path)


_SCORED = f"""WITH {_NAMED} SELECT id, code AS predicted_naics, round(confidence, 6) AS confidence
    FROM guess JOIN label_dim ON label_dim.label = prediction"""


@query(_SCORED)
def scored_as_csv(spark, sf_dir):
    return _stored_scores(spark, sf_dir, "csv")


@query(_SCORED)
def scored_as_json(spark, sf_dir):
    return _stored_scores(spark, sf_dir, "json")


@query(_SCORED)
def scored_as_parquet(spark, sf_dir):
    return _stored_scores(spark, sf_dir, "parquet")


@query(f"WITH {FIRST_USE_CTE} SELECT nwo, first_use_date FROM first_use")
def first_use_stored(spark, sf_dir):
    return writers.write_first_use(first_use(spark, sf_dir), shared_folder(spark, "first-use") + ".parquet")


@query(
    f"""WITH {REPOS_CTE} SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS label, code
    FROM (SELECT DISTINCT code FROM repos)"""
)
def label_map_stored(spark, sf_dir):
    folder = shared_folder(spark, "labels")
    writers.write_labels(corpus.label_dim(repos(spark, sf_dir)), f"{folder}/labels")
    return writers.load_labels(spark, folder)


@query(f"WITH {metric_ctes()}, {LABEL_CTE} {REPORT_SQL}")
def report_stored(spark, sf_dir):
    folder = shared_folder(spark, "report")
    result = evaluate_counts(counts(spark, sf_dir), label_dim(spark))
    writers.write_report(result.metrics, result.report, result.test_size, folder)
    return rounded(readers.read_report(spark, folder)["classes"], "precision", "recall", "f1").drop("seq")
