"""Code dimension operators over the codes found in documents."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import DIM_CTE, RAW_CODES_CTE, raw_codes, sql_list
from sectorscope.functions.codes import ALL_CODES, is_valid_code, normalize_code, sector_dim
from sectorscope.operators import dims

_TRIM = "trim(code, ' ' || chr(9))"


@query(
    f"""WITH {RAW_CODES_CTE}, {DIM_CTE} SELECT id, raw_codes.code, long_desc AS naics_description
    FROM raw_codes LEFT JOIN dim ON dim.code = trim(raw_codes.code, ' ' || chr(9))"""
)
def code_description_trimmed(spark, sf_dir):
    return dims.describe_codes(raw_codes(spark, sf_dir))


@query(
    f"""WITH {RAW_CODES_CTE}, {DIM_CTE} SELECT id, raw_codes.code, long_desc AS naics_description
    FROM raw_codes LEFT JOIN dim ON dim.code = raw_codes.code"""
)
def code_description_exact(spark, sf_dir):
    return dims.add_descriptions(raw_codes(spark, sf_dir))


@query(
    f"""WITH {RAW_CODES_CTE} SELECT code, count(*) AS n FROM raw_codes
    WHERE code IS NULL OR code NOT IN (SELECT unnest({sql_list(ALL_CODES)})) GROUP BY 1"""
)
def unmapped_codes(spark, sf_dir):
    return dims.unmapped_codes(raw_codes(spark, sf_dir))


@query(
    f"""WITH {RAW_CODES_CTE} SELECT id, CASE WHEN length({_TRIM}) > 2 AND NOT contains(code, '-') THEN substr({_TRIM}, 1, 2)
    ELSE {_TRIM} END AS code FROM raw_codes"""
)
def normalized_codes(spark, sf_dir):
    return raw_codes(spark, sf_dir).withColumn("code", normalize_code(F.col("code")))


@query(
    f"""WITH {RAW_CODES_CTE} SELECT id, coalesce({_TRIM} IN (SELECT unnest({sql_list(ALL_CODES)})), FALSE) AS valid FROM raw_codes"""
)
def valid_codes(spark, sf_dir):
    return raw_codes(spark, sf_dir).select("id", is_valid_code(F.col("code")).alias("valid"))


@query(
    f"""WITH {RAW_CODES_CTE}, {DIM_CTE}, n AS (SELECT code, count(*) AS n FROM raw_codes GROUP BY 1)
    SELECT seq, dim.code, long_desc, is_primary, is_sector, is_class, coalesce(n, 0) AS n_repos FROM dim LEFT JOIN n USING (code)"""
)
def code_lists_with_counts(spark, sf_dir):
    counts = raw_codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))
    # The counted side only has to be matched with 27 codes, so it is filtered to them first.
    known = counts.where(F.col("code").isin(ALL_CODES))
    listed = sector_dim(spark).join(F.broadcast(known), "code", "left")
    return listed.select(
        "seq", "code", "long_desc", "is_primary", "is_sector", "is_class", F.coalesce("n", F.lit(0)).alias("n_repos")
    )


@query(
    f"""WITH {RAW_CODES_CTE}, {DIM_CTE} SELECT id, raw_codes.code, coalesce(medium_desc, 'Unknown') AS batch_text,
    coalesce(short_desc, raw_codes.code) AS chart_text, coalesce(short_desc, 'Unknown') AS summary_text
    FROM raw_codes LEFT JOIN dim ON dim.code = raw_codes.code"""
)
def default_descriptions(spark, sf_dir):
    rows = dims.batch_description(raw_codes(spark, sf_dir), "code", "batch_text")
    rows = dims.short_description(rows, "code", "chart_text")
    return dims.short_description(rows, "code", "summary_text", default="Unknown")


@query(
    f"""WITH {RAW_CODES_CTE}, {DIM_CTE}, seen AS (SELECT DISTINCT dim.* FROM dim JOIN raw_codes USING (code))
    SELECT arg_min(code, seq) AS code, long_desc AS description, min(seq) AS seq FROM seen GROUP BY long_desc"""
)
def distinct_descriptions(spark, sf_dir):
    codes = raw_codes(spark, sf_dir).select("code").distinct().where(F.col("code").isin(ALL_CODES))
    seen = sector_dim(spark).join(F.broadcast(codes), "code", "left_semi")
    return dims.distinct_descriptions(seen)
