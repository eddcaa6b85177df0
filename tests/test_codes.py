from helpers import values
from pyspark.sql import functions as F

from sectorscope.functions import codes
from sectorscope.operators import dims


def frame(spark, *raw):
    return spark.createDataFrame([(c,) for c in raw], "code string")


def test_lists(spark):
    assert len(codes.ALL_CODES) == 27
    assert len(codes.PRIMARY_CODES) == 24
    assert len(codes.SECTOR_CODES) == 20
    assert codes.CLASS_CODES == [c for c in codes.SECTOR_CODES if c != "55"]
    assert dims.all_codes(spark).count() == 27
    assert [r.code for r in dims.primary_codes(spark).orderBy("seq").collect()] == codes.PRIMARY_CODES
    assert [r.code for r in dims.sectors(spark).orderBy("seq").collect()] == codes.SECTOR_CODES


def test_normalize_and_validate(spark):
    df = frame(spark, "541511", "31-33", " 52 ", "5", None)
    assert [r[0] for r in df.select(codes.normalize_code(F.col("code"))).collect()] == ["54", "31-33", "52", "5", None]
    df = frame(spark, "31", "31-33", " 52 ", "99", "541511", None)
    assert [r[0] for r in df.select(codes.is_valid_code(F.col("code"))).collect()] == [True, True, True, False, False, False]


def test_descriptions(spark):
    df = frame(spark, " 52 ", "52", "99", None)
    assert [r.naics_description for r in dims.describe_codes(df).collect()] == ["Finance and Insurance"] * 2 + [None, None]
    assert [r.naics_description for r in dims.add_descriptions(df).collect()] == [None, "Finance and Insurance", None, None]
    assert values(dims.unmapped_codes(frame(spark, "52", "99", "99", None)), "code") == [(None, 1), ("99", 2)]


def test_defaults_and_series(spark):
    df = frame(spark, "53", "55", "Other")
    assert [r.naics_description for r in dims.batch_description(df, "code").collect()] == [
        "Real Estate and Rental",
        "Unknown",
        "Unknown",
    ]
    assert [r.short_desc for r in dims.short_description(df, "code").collect()] == ["Real Estate", "55", "Other"]
    assert [r.short_desc for r in dims.short_description(df, "code", default="Unknown").collect()] == ["Real Estate", "Unknown", "Unknown"]
    assert [r.series for r in dims.series_label(df, "code").collect()] == ["53: Real Estate", "55: 55", "Other"]


def test_distinct_descriptions_keep_first_code(spark):
    rows = {r.description: r.code for r in dims.distinct_descriptions(codes.sector_dim(spark)).collect()}
    assert len(rows) == 20
    assert rows["Manufacturing"] == "31" and rows["Retail Trade"] == "44"
