"""URL filter: rules on host and path, and logistic regression on character n-grams for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; path: from
there up to ``?``, ``#`` or the end.  A rule (``host/path``) fits its host and all subdomains where the path
starts with its own; the longest one that fits decides.  URLs without a rule are judged by a
logistic regression, trained on labelled URLs, over hashed n-grams of host and path.

Judging is one pass over the pages without a shuffle, so a host with most pages costs no more than
others; everything runs in the JVM.  Long URLs take time in proportion to their length.

A null URL, or one without ``://``, has an empty host and path and is judged by the model without
any n-gram.  Labelled rows without URL or label are left out; with none of a kind, every URL is of
the other kind, and with none at all it is allowed.  Equal URLs are judged alike.  Null ids, repeated rows and all other
columns pass through; the new columns replace ones of the same name.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
REGULARIZATION = 1e-3
# Labelled rows for each task that trains: the passes over a small table cost little but their start.
ROWS_PER_TASK = 10_000
MAX_RULES = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (``host/path``, verdict) that fits, as struct of rule and verdict, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"More than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The longest first; of equal rules the one that is given first.
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        if verdict not in (ALLOW, BLOCK) or "/" not in rule:
            raise ValueError(f"Not a rule: {rule!r}, {verdict!r}")
        name, _, start = rule.partition("/")
        name = name.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def characters(text: Column) -> Column:
    """The characters of a text between its ends, which count as characters.

    Runs of digits are one digit: page numbers say nothing of a page.
    """
    return F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$")), "")


def ngrams(chars: Column, kind: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """All runs of ``sizes`` characters, marked with ``kind``.  ``chars`` has to be a stored column: it is
    looked at once for each run."""

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(chars)), lambda i: i <= F.size(chars) - F.lit(n))
        return F.transform(starts, lambda i: F.concat(F.lit(kind), *[F.get(chars, i + F.lit(k)) for k in range(n)]))

    return F.flatten(F.array(*[runs(n) for n in sizes]))


def _features(rows: DataFrame) -> DataFrame:
    """With ``_features``: hashed n-grams of ``_host`` and ``_path``; none for an empty URL."""
    rows = rows.withColumns({"_hc": characters(F.col("_host")), "_pc": characters(F.col("_path"))})
    grams = F.concat(ngrams(F.col("_hc"), "h:"), ngrams(F.col("_pc"), "p:"))
    empty = (F.col("_host") == "") & (F.col("_path") == "")
    rows = rows.withColumn("_grams", F.when(empty, F.array().cast("array<string>")).otherwise(grams))
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    return hashing.transform(rows.drop("_hc", "_pc")).drop("_grams")


def train(labelled: DataFrame) -> LogisticRegressionModel | float:
    """The model of ``labelled`` (url, label 1: block), or the one probability where it has one kind."""
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1))
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    rows = known.repartition(-(-sum(counts.values()) // ROWS_PER_TASK)).select(
        host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), F.col("label").cast("double").alias("_label")
    )
    fit = LogisticRegression(
        featuresCol="_features", labelCol="_label", probabilityCol="_both", rawPredictionCol="_raw", predictionCol="_guess",
        regParam=REGULARIZATION, standardization=False, maxIter=200, tol=1e-8,
    )
    return fit.fit(_features(rows))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """``pages`` (url, any other columns) with ``host``, ``path``, ``rule``, ``score`` (probability that the URL is
    to be blocked) and ``verdict``: the rule's, else block where the score exceeds ``threshold``.

    Runs the jobs that train the model.
    """
    model = train(labelled)
    new = ("host", "path", "rule", "score", "verdict")
    others = [c for c in pages.columns if c not in new]
    rows = pages.select(
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others]).alias("_row"),
        host_of(F.col("url")).alias("_host"),
        path_of(F.col("url")).alias("_path"),
    )
    if isinstance(model, float):
        scored = rows.withColumn("_score", F.lit(model))
    else:
        scored = model.transform(_features(rows)).withColumn("_score", F.get(vector_to_array("_both"), F.lit(1)))
    scored = scored.select("_row", "_host", "_path", "_score", rule_for(F.col("_host"), F.col("_path"), rules).alias("_rule"))
    by_model = F.when(F.col("_score") > threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        "_row.*",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.col("_score").alias("score"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"),
    )
