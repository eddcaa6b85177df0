"""Adoption by month and industry over orders and customers."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import (
    DIM_CTE,
    FIRST_USE_CTE,
    MERGED_CTE,
    MONTHLY_CTE,
    TOOL_MONTHLY_CTE,
    predictions,
    sql_text,
    tool_events,
)
from sectorscope.functions.codes import CLASS_CODES
from sectorscope.operators import adoption as ad
from sectorscope.plans.adoption import adoption_report, tool_adoption
from sectorscope.sources.paths import shared_folder

TOP = 10
# Tools are files: a job names each of them.
MAX_TOOLS = 100


def first_use(spark, sf_dir):
    return ad.first_use(tool_events(spark, sf_dir))


def monthly(spark, sf_dir):
    return ad.monthly_adoption(first_use(spark, sf_dir), predictions(spark, sf_dir))


@query(f"WITH {FIRST_USE_CTE} SELECT nwo, first_use_date FROM first_use")
def first_use_by_repo(spark, sf_dir):
    return first_use(spark, sf_dir)


@query(f"WITH {MERGED_CTE} SELECT nwo, predicted_naics FROM predictions")
def predictions_pruned(spark, sf_dir):
    return ad.repo_codes(predictions(spark, sf_dir))


@query(f"WITH {MERGED_CTE} SELECT nwo, first_use_date, predicted_naics FROM merged")
def first_use_with_industry(spark, sf_dir):
    return ad.merge_predictions(first_use(spark, sf_dir), predictions(spark, sf_dir))


@query(f"WITH {MONTHLY_CTE} SELECT month, predicted_naics, n FROM monthly")
def monthly_by_industry(spark, sf_dir):
    return ad.by_month_and_industry(
        ad.merge_predictions(first_use(spark, sf_dir), predictions(spark, sf_dir))
    )


@query(f"WITH {MONTHLY_CTE} SELECT month, predicted_naics, n FROM monthly")
def monthly_adoption(spark, sf_dir):
    return monthly(spark, sf_dir)


_WIDE = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE predicted_naics = {sql_text(c)}), 0) AS BIGINT) AS \"{c}\"" for c in CLASS_CODES
)


@query(f"WITH {MONTHLY_CTE} SELECT month, {_WIDE} FROM monthly GROUP BY month ORDER BY month")
def monthly_pivot(spark, sf_dir):
    return ad.month_by_industry(monthly(spark, sf_dir), CLASS_CODES)


_TOTALS = "totals AS (SELECT predicted_naics, CAST(sum(n) AS BIGINT) AS n FROM monthly GROUP BY 1)"


@query(f"WITH {MONTHLY_CTE}, {_TOTALS} SELECT predicted_naics, n FROM totals ORDER BY n DESC, predicted_naics")
def industry_totals(spark, sf_dir):
    return ad.industry_totals(monthly(spark, sf_dir))


@query(
    f"""WITH {MONTHLY_CTE}, {_TOTALS}, {DIM_CTE},
    range AS (SELECT min(month) AS first_month, max(month) AS last_month, CAST(sum(n) AS BIGINT) AS total_repos FROM monthly),
    ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, predicted_naics) AS INTEGER) AS rank FROM totals)
    SELECT first_month, last_month, total_repos, rank, predicted_naics, coalesce(short_desc, 'Unknown') AS industry, n
    FROM ranked CROSS JOIN range LEFT JOIN dim ON dim.code = predicted_naics WHERE rank <= 5"""
)
def adoption_summary(spark, sf_dir):
    return ad.adoption_summary(monthly(spark, sf_dir))


_TOP = f"""{_TOTALS}, ranked AS (SELECT predicted_naics, row_number() OVER (ORDER BY n DESC, predicted_naics) AS rank FROM totals),
grouped AS (SELECT month, CASE WHEN rank <= {TOP} THEN predicted_naics ELSE 'Other' END AS industry, CAST(sum(n) AS BIGINT) AS n
  FROM monthly JOIN ranked USING (predicted_naics) GROUP BY 1, 2)"""


@query(f"WITH {MONTHLY_CTE}, {_TOP} SELECT month, industry, n FROM grouped")
def top_industries_by_month(spark, sf_dir):
    return ad.top_industries(monthly(spark, sf_dir), TOP)


@query(
    f"""WITH {MONTHLY_CTE}, {_TOP}, {DIM_CTE} SELECT month, n,
    CASE WHEN industry = 'Other' THEN 'Other' ELSE industry || ': ' || coalesce(short_desc, industry) END AS series
    FROM grouped LEFT JOIN dim ON dim.code = industry"""
)
def chart_series(spark, sf_dir):
    return ad.chart_series(monthly(spark, sf_dir), TOP)


@query(
    f"""WITH {MONTHLY_CTE}, {_TOP}, {DIM_CTE}, named AS (SELECT month, n,
      CASE WHEN industry = 'Other' THEN 'Other' ELSE industry || ': ' || coalesce(short_desc, industry) END AS series
      FROM grouped LEFT JOIN dim ON dim.code = industry),
    places AS (SELECT series, CAST(row_number() OVER (ORDER BY series = 'Other', sum(n) DESC, series) AS INTEGER) AS place FROM named GROUP BY series)
    SELECT month, place, series, coalesce(n, 0) AS n FROM (SELECT DISTINCT month FROM named) CROSS JOIN places LEFT JOIN named USING (month, series)"""
)
def chart_table_cells(spark, sf_dir):
    """The wide chart table, its columns numbered in their order with ``Other`` last."""
    wide = ad.chart_table(monthly(spark, sf_dir), TOP)
    cells = [
        F.struct(F.lit(k).alias("place"), F.lit(c).alias("series"), F.col(f"`{c}`").alias("n"))
        for k, c in enumerate(wide.columns[1:], 1)
    ]
    return wide.select("month", F.explode(F.array(*cells)).alias("c")).select("month", "c.*")


def by_tool(spark, sf_dir):
    return tool_adoption(tool_events(spark, sf_dir), predictions(spark, sf_dir), "repo_nwo", "created_at")


@query(f"WITH {TOOL_MONTHLY_CTE} SELECT tool, month, predicted_naics, n FROM monthly")
def adoption_by_tool(spark, sf_dir):
    return by_tool(spark, sf_dir)


@query(
    f"""WITH {TOOL_MONTHLY_CTE}, {DIM_CTE},
    totals AS (SELECT tool, predicted_naics, CAST(sum(n) AS BIGINT) AS n, min(month) AS a, max(month) AS b FROM monthly GROUP BY 1, 2),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY tool ORDER BY n DESC, predicted_naics) AS INTEGER) AS rank,
      min(a) OVER (PARTITION BY tool) AS first_month, max(b) OVER (PARTITION BY tool) AS last_month,
      CAST(sum(n) OVER (PARTITION BY tool) AS BIGINT) AS total_repos FROM totals)
    SELECT tool, first_month, last_month, total_repos, rank, predicted_naics, coalesce(short_desc, 'Unknown') AS industry, n
    FROM ranked LEFT JOIN dim ON dim.code = predicted_naics WHERE rank <= 5"""
)
def adoption_summary_by_tool(spark, sf_dir):
    return ad.adoption_summary(by_tool(spark, sf_dir), by=["tool"])


@query(
    f"""WITH {TOOL_MONTHLY_CTE},
    totals AS (SELECT tool, predicted_naics, sum(n) AS t FROM monthly GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY t DESC, predicted_naics) AS rank FROM totals)
    SELECT tool, month, CASE WHEN rank <= {TOP} THEN predicted_naics ELSE 'Other' END AS industry, CAST(sum(n) AS BIGINT) AS n
    FROM monthly JOIN ranked USING (tool, predicted_naics) GROUP BY 1, 2, 3"""
)
def top_industries_by_tool(spark, sf_dir):
    return ad.top_industries(by_tool(spark, sf_dir), TOP, by=["tool"])


@query(f"WITH {TOOL_MONTHLY_CTE} SELECT tool, month, predicted_naics, n FROM monthly")
def adoption_files_job(spark, sf_dir):
    """Every tool with an event file and a scored table of its own; one comes with first use computed,
    the others are stored on the way."""
    folder = shared_folder(spark, "adoption")
    events = tool_events(spark, sf_dir)
    tools = [r[0] for r in events.select("tool").distinct().orderBy("tool").limit(MAX_TOOLS + 1).collect()]
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"More than {MAX_TOOLS} tools for a job that names a file for each")
    paths, scored = {}, {}
    for k, tool in enumerate(tools):
        own = events.where(F.col("tool") == tool).select(
            F.col("repo_nwo").cast("string").alias("repo_nwo"), F.col("created_at").cast("timestamp").alias("created_at")
        )
        scored[tool] = f"{folder}/{k}-scored.parquet"
        predictions(spark, sf_dir).withColumn("nwo", F.col("nwo").cast("string")).write.parquet(scored[tool])
        if k == 0:
            paths[tool] = f"{folder}/{k}.parquet"
            first = ad.first_use(own).withColumnsRenamed({"nwo": "repo_nwo", "first_use_date": "first_claude_commit"})
            first.write.parquet(paths[tool])
        else:
            paths[tool] = f"{folder}/{k}.jsonl"
            own.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(paths[tool])
    return adoption_report(spark, paths, scored, computed=tuple(tools[:1]), first_use_dir=f"{folder}/first-use")
