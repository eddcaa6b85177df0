import datetime as dt

import pytest
from helpers import values
from pyspark.sql import functions as F

from sectorscope.operators import adoption as ad
from sectorscope.operators import sizing
from sectorscope.plans import adoption as plan
from sectorscope.sources import readers

JAN, MAR = dt.date(2025, 1, 1), dt.date(2025, 3, 1)


def first(spark):
    rows = [("r1", "2025-01-15"), ("r2", "2025-01-20"), ("r3", "2025-03-02"), ("r4", "2025-03-02"), (None, "2025-01-01")]
    return spark.createDataFrame(rows, "nwo string, d string").select("nwo", F.to_timestamp("d").alias("first_use_date"))


def predictions(spark):
    rows = [("r1", "52", 1.0), ("r2", "62", 1.0), ("r3", "52", 1.0), ("r4", None, 1.0), (None, "11", 1.0), ("r9", "11", 1.0)]
    return spark.createDataFrame(rows, "nwo string, predicted_naics string, confidence double")


def monthly(spark):
    return ad.monthly_adoption(first(spark), predictions(spark))


def test_monthly(spark):
    want = [(JAN, "52", 1), (JAN, "62", 1), (MAR, "52", 1)]
    assert values(monthly(spark), "month", "predicted_naics") == want
    merged = ad.merge_predictions(first(spark), predictions(spark))
    assert merged.columns == ["nwo", "first_use_date", "predicted_naics"]
    assert values(ad.by_month_and_industry(merged), "month", "predicted_naics") == want


def test_repeated_predictions_multiply(spark):
    twice = predictions(spark).union(predictions(spark))
    assert values(ad.monthly_adoption(first(spark), twice), "month", "predicted_naics") == [(JAN, "52", 2), (JAN, "62", 2), (MAR, "52", 2)]
    assert ad.merge_predictions(first(spark), twice).count() == 8


def test_hot_repository(spark, monkeypatch):
    monkeypatch.setattr(sizing.hot_key_join, "__defaults__", ("inner", 0.05, 10, 5))
    hot = spark.range(100).select(F.lit("r1").alias("nwo"), F.lit("11").alias("predicted_naics"), F.lit(1.0).alias("confidence"))
    both = predictions(spark).union(hot)
    merged = ad.by_month_and_industry(ad.merge_predictions(first(spark), both))
    assert values(merged, "month", "predicted_naics") == values(ad.monthly_adoption(first(spark), both), "month", "predicted_naics")
    assert (JAN, "11", 100) in values(merged)


def test_wide_form(spark):
    assert ad.codes_present(monthly(spark)) == ["52", "62"]
    wide = ad.month_by_industry(monthly(spark), ["52", "62"])
    assert values(wide) == [(JAN, 1, 1), (MAR, 1, 0)]
    assert values(ad.chart_table(monthly(spark), top=1)) == [(JAN, 1, 1), (MAR, 1, 0)]
    assert ad.chart_table(monthly(spark), top=1).columns == ["month", "52: Finance", "Other"]
    assert ad.chart_table(monthly(spark), top=2).columns == ["month", "52: Finance", "62: Healthcare"]


def test_wide_form_keeps_codes_that_are_not_listed(spark):
    rows = [(JAN, "52", 3), (JAN, "55", 2), (MAR, "zz", 4)]
    long = spark.createDataFrame(rows, "month date, predicted_naics string, n long")
    wide = ad.month_by_industry(long, ["52", "62"])
    assert wide.columns == ["month", "52", "62", "55", "zz"]
    assert values(wide) == [(JAN, 3, 0, 2, 0), (MAR, 0, 0, 0, 4)]
    assert ad.month_by_industry(long).columns == ["month", "52", "55", "zz"]


def test_too_many_codes(spark, monkeypatch):
    monkeypatch.setattr(ad, "MAX_COLUMNS", 1)
    with pytest.raises(ValueError):
        ad.month_by_industry(monthly(spark))


def test_totals_and_summary(spark):
    assert values(ad.industry_totals(monthly(spark))) == [("52", 2), ("62", 1)]
    assert values(ad.adoption_summary(monthly(spark), 5), "rank") == [
        (JAN, MAR, 3, 1, "52", "Finance", 2), (JAN, MAR, 3, 2, "62", "Healthcare", 1)
    ]


def test_month_is_utc(spark):
    event = spark.createDataFrame([("r", "2025-02-28T23:30:00-02:00")], "repo_nwo string, t string")
    events = event.select("repo_nwo", F.to_timestamp("t").alias("created_at"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    for session_zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            use = ad.first_use(events)
            assert use.select(ad.utc_month(use, "first_use_date")).first()[0] == MAR
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def test_pivot_sums_equal_long_form(spark, sf_dir):
    from bindings.adoption import monthly as bound
    from sectorscope.functions.codes import CLASS_CODES

    m = bound(spark, sf_dir)
    wide = ad.month_by_industry(m, CLASS_CODES).collect()
    per_month = {r.month: r.n for r in m.groupBy("month").agg(F.sum("n").alias("n")).collect()}
    assert {r.month: sum(r[c] for c in CLASS_CODES) for r in wide} == per_month
    assert [r.month for r in wide] == sorted(per_month)


def test_top_and_totals_agree(spark, sf_dir):
    from bindings.adoption import monthly as bound

    m = bound(spark, sf_dir)
    total = m.agg(F.sum("n")).first()[0]
    for top in (1, 10, 50):
        assert ad.top_industries(m, top).agg(F.sum("n")).first()[0] == total
    assert ad.top_industries(m, 50).where("industry = 'Other'").count() == 0


def test_tools_from_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"repo_nwo": "r1", "created_at": "2025-02-28T23:30:00-02:00", "x": 1}\n'
        '{"repo_nwo": "r1", "created_at": "2025-01-02T00:00:00Z"}\n'
        '{"repo_nwo": "r2", "created_at": "2025-02-28T23:30:00-02:00"}\n'
        '{"created_at": "2025-02-28T23:30:00-02:00"}\nbroken\n'
    )
    table = spark.createDataFrame([("r3", "2025-03-05")], "repo_nwo string, d string")
    table.select("repo_nwo", F.to_timestamp("d").alias("first_claude_commit")).write.parquet(str(tmp_path / "b.parquet"))
    predictions(spark).write.parquet(str(tmp_path / "p.parquet"))
    scored = dict.fromkeys("abc", str(tmp_path / "p.parquet"))
    events = {"a": str(tmp_path / "a.jsonl"), "b": str(tmp_path / "b.parquet"), "c": str(tmp_path / "none.jsonl")}
    want = [("a", JAN, "52", 1), ("a", MAR, "62", 1), ("b", MAR, "52", 1)]
    for folder in (None, str(tmp_path / "first")):
        with pytest.warns(UserWarning, match="c"):
            report = plan.adoption_report(spark, events, scored, computed=("b",), first_use_dir=folder, strict=False)
        assert values(report.select("tool", "month", "predicted_naics", "n"), "tool", "month") == want
    assert spark.read.parquet(str(tmp_path / "first" / "a_first_use.parquet")).count() == 2


def test_tool_groups_skip_missing(spark):
    with pytest.warns(UserWarning, match="y"):
        stacked = plan.stack_tools({"x": first(spark), "y": None})
    assert {r.tool for r in stacked.collect()} == {"x"}
    with pytest.raises(ValueError):
        plan.stack_tools({})


def test_broken_events_and_missing_tables(spark, tmp_path):
    lines = ['{"repo_nwo": "r1", "created_at": "2025-01-15T00:00:00Z"}', '{"repo_nwo": "r2", "created_at": "soon"}', '{"repo_nwo"']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    predictions(spark).write.parquet(str(tmp_path / "p.parquet"))
    files = ({"t": str(tmp_path / "e.jsonl")}, {"t": str(tmp_path / "p.parquet")})
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        plan.adoption_report(spark, *files).collect()
    assert plan.adoption_report(spark, *files, strict=False).collect()[0].n == 1
    assert tuple(readers.broken_events(spark, str(tmp_path / "e.jsonl")).first()) == (3, 2)
    with pytest.raises(FileNotFoundError):
        plan.adoption_report(spark, {"t": str(tmp_path / "none.parquet")}, files[1], computed=("t",))
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        plan.adoption_report(spark, {"t": str(tmp_path / "none.jsonl")}, files[1])


def test_too_many_tools_are_an_error(spark, monkeypatch):
    from bindings import adoption as bound

    events = spark.range(bound.MAX_TOOLS + 1).selectExpr("concat('t', id) tool", "'a/b' repo_nwo", "'2024-01-01' created_at")
    monkeypatch.setattr(bound, "tool_events", lambda *_: events)
    with pytest.raises(ValueError, match="tools"):
        bound.adoption_files_job(spark, "")
