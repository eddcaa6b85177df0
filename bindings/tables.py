"""The given tables, seen as the relations the library works on.

``*_CTE`` strings build the same relations in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.functions.codes import CLASS_CODES, SECTOR_CODES, SECTORS
from sectorscope.operators.classify import score_logits
from sectorscope.operators.sizing import local_table
from sectorscope.sources.readers import read_parquet

CODE = "predicted_naics"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


# --- repositories: one per document -------------------------------------------------------
# Text put around every document so that each cleaning rule has work to do.
NOISE_HEAD = (
    "# Title\n[![b](https://ci.example.com/b.svg)](https://ci.example.com/x) Read https://docs.example.com/a/b now.\n"
    "## Use **bold** and `code`: js, Py, node.js, ReactJS!!! ok??\nMIT License\nCopyright 2020 someone\n\n \n"
)
NOISE_TAIL = "\nwait......\nGPL\nPIP install thing\nnot read any more"
# Every third row has the tail without an install line, which would drop the rest, and every
# third one an open badge.
PLAIN_TAIL = "\nwait......\nBSD\r\nread **to** the end??? node"
OPEN_TAIL = "\n[![open](https://ci.example.com/c.svg) still [![ here\n[![again"


def source_number() -> Column:
    return F.substring("source", 4, 4).cast("int")


def topics_raw() -> Column:
    """Topics in seven stored shapes, chosen by source."""
    lang, source = F.col("lang"), F.col("source")
    shapes = [
        F.concat(F.lit("['"), lang, F.lit("', '"), source, F.lit("']")),
        F.concat(F.lit('["'), lang, F.lit('","'), source, F.lit('"]')),
        F.concat(F.lit("["), lang, F.lit(", "), source, F.lit("]")),
        F.concat(lang, F.lit(", "), source),
        F.lit(None).cast("string"),
        F.lit("[]"),
        F.concat(F.lit("['"), lang, F.lit("', None, '', 1,]")),
    ]
    out = F.when(source_number() % 7 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        out = out.when(source_number() % 7 == i, shape)
    return out


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for a text job: the given file is one row group, so as many parts as there are cores."""
    return read_parquet(spark, f"{sf_dir}/documents.parquet", partitions=spark.sparkContext.defaultParallelism)


def repos(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    docs = spread_documents(spark, sf_dir) if noisy else table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    tail = F.when(kind == 0, NOISE_TAIL).when(kind == 1, PLAIN_TAIL).otherwise(OPEN_TAIL)
    readme = F.concat(F.lit(NOISE_HEAD), F.col("text"), tail) if noisy else F.col("text")
    return docs.select(
        F.col("doc_id").alias("id"),
        pick(SECTOR_CODES, source_number()).alias("code"),
        F.concat(F.lit("repo_"), F.col("doc_id")).alias("name_repo"),
        F.col("lang").alias("description"),
        topics_raw().alias("topics"),
        readme.alias("readme_content"),
    )


_TOPICS_SQL = """CASE CAST(substr(source, 4) AS INTEGER) % 7
  WHEN 0 THEN '[''' || lang || ''', ''' || source || ''']'
  WHEN 1 THEN '["' || lang || '","' || source || '"]'
  WHEN 2 THEN '[' || lang || ', ' || source || ']'
  WHEN 3 THEN lang || ', ' || source
  WHEN 4 THEN NULL
  WHEN 5 THEN '[]'
  ELSE '[''' || lang || ''', None, '''', 1,]' END"""


def _repos_cte(readme: str) -> str:
    return f"""repos AS (SELECT doc_id AS id, {sql_list(SECTOR_CODES)}[CAST(substr(source, 4) AS INTEGER) + 1] AS code,
  'repo_' || doc_id AS name_repo, lang AS description, {_TOPICS_SQL} AS topics, {readme} AS readme_content
  FROM documents)"""


REPOS_CTE = _repos_cte("text")
_TAIL_SQL = (
    f"CASE doc_id % 3 WHEN 0 THEN {sql_text(NOISE_TAIL)} WHEN 1 THEN {sql_text(PLAIN_TAIL)} ELSE {sql_text(OPEN_TAIL)} END"
)
NOISY_REPOS_CTE = _repos_cte(f"{sql_text(NOISE_HEAD)} || text || {_TAIL_SQL}")


def sql_topics(col: str) -> str:
    """Topics to ``a; b``, for the stored shapes above."""
    return (
        f"coalesce(array_to_string([trim(t) for t in string_split(regexp_replace({col}, '[\\[\\]''\"]', '', 'g'), ',')"
        f" if trim(t) NOT IN ('', 'None')], '; '), '')"
    )


def sql_clean(expr: str) -> str:
    """The cleaning rules in the regex dialect of the oracle (no look-around, ASCII classes)."""
    # Fixed values: (pattern, replacement, flags) in the order that defines the result.
    rules = [
        (r"!\[.*?\]\(.*?\)", "", "g"),
        (r"\[!\[.*?\]\(.*?\)\]\(.*?\)", "", "g"),
        (r"(MIT License|Apache License|GPL|BSD|Copyright.*?)(\n|$)", "", "gi"),
        (r"https?://([^/\s]+)[^\s]*", r"\1", "g"),
        (r"(?m)^#{1,6}\s*", "", "g"),
        (r"[*_~`]+", "", "g"),
        (r"\b(javascript|js)\b", "javascript", "gi"),
        (r"\b(python|py)\b", "python", "gi"),
        (r"\b(react|reactjs)\b", "react", "gi"),
        (r"\b(node|nodejs)\b", "nodejs", "gi"),
        (r"!!+", "!", "g"),
        (r"\?\?+", "?", "g"),
        (r"\.\.\.+", "...", "g"),
        (r"\s+", " ", "g"),
        (r"(npm install|pip install|git clone).*", "", "gi"),
    ]
    out = expr
    for pattern, to, flags in rules:
        out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(to)}, '{flags}')"
    return f"trim({out})"


# --- dimension -----------------------------------------------------------------------------
def _bool(value: bool) -> str:
    return "TRUE" if value else "FALSE"


def dim_cte() -> str:
    rows = ", ".join(
        f"({sql_text(code)}, {seq}, {sql_text(long)}, {sql_text(medium)}, {sql_text(short)}, "
        f"{_bool('-' not in code)}, {_bool(code in SECTOR_CODES)}, {_bool(code in CLASS_CODES)})"
        for seq, (code, long, medium, short) in enumerate(SECTORS)
    )
    return (
        "dim(code, seq, long_desc, medium_desc, short_desc, is_primary, is_sector, is_class) AS "
        f"(SELECT * FROM (VALUES {rows}))"
    )


DIM_CTE = dim_cte()


def label_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(enumerate(CLASS_CODES)), "label int, code string")


def label_cte(name: str = "label_dim") -> str:
    rows = ", ".join(f"({i}, {sql_text(c)})" for i, c in enumerate(CLASS_CODES))
    return f"{name}(label, code) AS (SELECT * FROM (VALUES {rows}))"


LABEL_CTE = label_cte()


# --- codes as found in the wild: sector codes, padded text, long numbers, unknown ones -------
def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = (
        F.when(F.col("lang") == "fr", F.concat(F.lit(" "), pick(SECTOR_CODES, source_number()), F.lit("\t")))
        .when(F.col("lang") == "de", F.col("n_chars").cast("string"))
        .when(F.col("lang") == "es", (F.col("n_chars") % 100).cast("string"))
        .when(F.col("n_chars") % 10 != 0, pick([row[0] for row in SECTORS], F.col("n_chars") % len(SECTORS)))
    )
    return docs.select(F.col("doc_id").alias("id"), code.alias("code"))


RAW_CODES_CTE = f"""raw_codes AS (SELECT doc_id AS id, CASE
  WHEN lang = 'fr' THEN ' ' || {sql_list(SECTOR_CODES)}[CAST(substr(source, 4) AS INTEGER) + 1] || chr(9)
  WHEN lang = 'de' THEN CAST(n_chars AS VARCHAR)
  WHEN lang = 'es' THEN CAST(n_chars % 100 AS VARCHAR)
  WHEN n_chars % 10 <> 0 THEN {sql_list(row[0] for row in SECTORS)}[n_chars % {len(SECTORS)} + 1] END AS code
  FROM documents)"""


# --- adoption: orders are tool events, customers are scored repositories ----------------------
def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo_nwo"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("tool"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("nwo"), pick(CLASS_CODES, F.col("c_nationkey") % len(CLASS_CODES)).alias(CODE)
    )


PREDICTIONS_CTE = f"""predictions AS (SELECT c_custkey AS nwo,
  {sql_list(CLASS_CODES)}[c_nationkey % {len(CLASS_CODES)} + 1] AS predicted_naics FROM customer)"""
FIRST_USE_CTE = "first_use AS (SELECT o_custkey AS nwo, min(o_orderdate) AS first_use_date FROM orders GROUP BY 1)"
MERGED_CTE = f"""{PREDICTIONS_CTE}, {FIRST_USE_CTE},
merged AS (SELECT f.nwo, f.first_use_date, p.predicted_naics FROM first_use f JOIN predictions p USING (nwo))"""
MONTHLY_CTE = f"""{MERGED_CTE}, monthly AS (SELECT CAST(date_trunc('month', first_use_date) AS DATE) AS month,
  predicted_naics, count(*) AS n FROM merged GROUP BY 1, 2)"""
TOOL_MONTHLY_CTE = f"""{PREDICTIONS_CTE},
first_use AS (SELECT o_orderpriority AS tool, o_custkey AS nwo, min(o_orderdate) AS first_use_date FROM orders GROUP BY 1, 2),
monthly AS (SELECT tool, CAST(date_trunc('month', first_use_date) AS DATE) AS month, predicted_naics, count(*) AS n
  FROM first_use JOIN predictions USING (nwo) GROUP BY 1, 2, 3)"""


# --- logits: the whole embedding folded into ten class scores -----------------------------------
N_LOGITS = 10


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def total(k: Column) -> Column:
        mine = F.filter(F.col("embedding"), lambda x, i: i % N_LOGITS == k)
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    scores = F.transform(F.sequence(F.lit(0), F.lit(N_LOGITS - 1)), total)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", scores.alias("logits"))


LOGITS_CTE = f"""elements AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS i,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
logit AS (SELECT id, label, CAST(i % {N_LOGITS} AS INTEGER) AS class_index, sum(x) AS z FROM elements GROUP BY 1, 2, 3),
prob AS (SELECT id, label, class_index, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM logit),
guess AS (SELECT id, any_value(label) AS label, CAST(arg_max(class_index, p) AS INTEGER) AS prediction, max(p) AS confidence
  FROM prob GROUP BY id)"""

# --- split of the embeddings, as used by the evaluation queries ----------------------------------
SEED = 42


def split_cte(source: str, label: str = "label", id_col: str = "id") -> str:
    """Exact stratified split in SQL: quotas by largest remainder, rank by md5 of seed and id."""

    def quota(prefix: str, size: str, seats: str, base: str) -> str:
        return f"""{prefix}_share AS (SELECT *, {seats} AS seats, sum({size}) OVER () AS total FROM {base}),
{prefix}_whole AS (SELECT *, CAST({size} AS HUGEINT) * seats // total AS whole, CAST({size} AS HUGEINT) * seats % total AS remainder FROM {prefix}_share),
{prefix}_quota AS (SELECT * EXCLUDE (seats, total, whole, remainder), CAST(whole + CASE WHEN
  row_number() OVER (ORDER BY remainder DESC, {label}) <= seats - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_{prefix} FROM {prefix}_whole)"""

    return f"""sizes AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY 1),
{quota("test", "n", "CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)", "sizes")},
rest AS (SELECT *, n - n_test AS n_rest FROM test_quota),
{quota("val", "n_rest", "CAST(ceil(CAST(0.125 AS DOUBLE) * sum(n_rest) OVER ()) AS BIGINT)", "rest")},
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('{SEED}:' || {id_col})) AS pos FROM {source} s),
split AS (SELECT r.* EXCLUDE (pos), CASE WHEN pos <= n_test THEN 'test' WHEN pos <= n_test + n_val THEN 'validation'
  ELSE 'train' END AS split FROM ranked r JOIN val_quota USING ({label}))"""


# --- scorer for texts that SQL can repeat: counts of letter pairs ---------------------------------
PAIRS = ["th", "en", "er", "ou", "on", "re", "an", "de", "le", "ai", "ie", "st", "ch", "la", "in", "un", "ti", "qu", "el"]
PAIR_WEIGHT = 0.05


def pair_scorer(pairs=tuple(PAIRS), weight=PAIR_WEIGHT):
    """Opener of a stand-in model: texts -> logits.

    The opener is an inner function, so it travels to the workers by value.
    """

    def open_scorer():
        def score(texts):
            return [[weight * t.count(p) for p in pairs] for t in texts]

        return score

    return open_scorer


def pair_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``probabilities`` of the letter-pair scorer, from column expressions."""
    col = F.coalesce(F.col(text), F.lit(""))
    found = [(F.length(col) - F.length(F.replace(col, F.lit(p), F.lit("")))) / 2 for p in PAIRS]
    return score_logits(df.withColumn("_logits", F.array(*[x * PAIR_WEIGHT for x in found])), "_logits").drop("_logits")


def pair_prob_cte(source: str, id_col: str = "id") -> str:
    """Class probabilities of ``source(id, text)`` under the letter-pair scorer."""
    counts = ", ".join(
        f"{PAIR_WEIGHT} * ((length(text) - length(replace(text, '{p}', ''))) // 2)::DOUBLE" for p in PAIRS
    )
    return f"""pair_logit AS (SELECT {id_col}, CAST(generate_subscripts([{counts}], 1) - 1 AS INTEGER) AS class_index,
  unnest([{counts}]) AS z FROM {source}),
pair_top AS (SELECT {id_col}, max(z) AS top FROM pair_logit GROUP BY 1),
pair_exp AS (SELECT {id_col}, class_index, exp(z - top) AS e FROM pair_logit JOIN pair_top USING ({id_col})),
pair_prob AS (SELECT {id_col}, class_index, e / sum(e) OVER (PARTITION BY {id_col}) AS p FROM pair_exp),
pair_guess AS (SELECT {id_col}, min(class_index) FILTER (WHERE p = top_p) AS class_index, max(p) AS confidence
  FROM (SELECT *, max(p) OVER (PARTITION BY {id_col}) AS top_p FROM pair_prob) GROUP BY 1)"""
