import json

import pytest
from helpers import values
from pyspark.sql import functions as F

from sectorscope.operators import adoption as ad
from sectorscope.sources import paths, readers, writers

ROWS = [("52", 'a "quoted", b', "two\nlines", None), ("31-33", "", "é ü", "x")]
SCHEMA = "code string, name_repo string, description string, topics string"


def test_missing_and_broken_parquet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_parquet(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(ValueError):
        readers.read_parquet(spark, str(tmp_path / "bad.parquet")).count()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "r.csv")
    writers.write_scored(df, path)
    want = sorted(tuple(v or None for v in row) for row in ROWS)
    assert values(readers.read_repos(spark, path, SCHEMA), "code") == want
    assert values(readers.read_repos(spark, path), "code") == want


def test_csv_holds_nested_values_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, topics array<string>")
    writers.write_batch(df, str(tmp_path / "n.csv"))
    assert values(readers.read_csv(spark, str(tmp_path / "n.csv"))) == [("1", '["a","b"]')]


@pytest.mark.parametrize("name, kind", [("o.json", "json"), ("o.parquet", "parquet"), ("o.txt", "csv"), ("o", "csv")])
def test_write_by_suffix(spark, tmp_path, name, kind):
    path = str(tmp_path / name)
    writers.write_scored(spark.createDataFrame(ROWS[1:], SCHEMA), path)
    stored = spark.read.schema(SCHEMA).option("header", True).format(kind).load(path)
    assert values(stored.select("code")) == [("31-33",)]


def test_batch_output_is_parquet_by_default(spark, tmp_path):
    writers.write_batch(spark.range(3).toDF("id"), str(tmp_path / "out.dat"))
    assert spark.read.parquet(str(tmp_path / "out.dat")).count() == 3


def test_unknown_input_type(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_repos(spark, str(tmp_path / "x.xlsx"))


def test_events(spark, tmp_path):
    lines = ['{"repo_nwo": "a", "created_at": "2025-01-01T00:00:00Z", "n": {"x": 1}}', "{broken"]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    events = readers.read_events(spark, str(tmp_path / "e.jsonl"), strict=False)
    assert events.columns == ["repo_nwo", "created_at"] and events.count() == 2
    assert ad.first_use(events).count() == 1
    with pytest.raises(Exception):
        readers.read_events(spark, str(tmp_path / "e.jsonl"), strict=True).collect()


def test_event_time_without_offset_is_utc(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"repo_nwo": "a", "created_at": "1970-01-02T00:00:00"}')
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        events = readers.read_events(spark, str(tmp_path / "e.jsonl"), strict=False)
        assert events.select(F.unix_seconds("created_at")).first()[0] == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_column_aliases(spark):
    old = spark.createDataFrame([("n", "r")], "name_repo string, readme_content string")
    assert readers.resolve_repo_columns(old).columns == ["name", "readme"]
    both = spark.createDataFrame([("n", "x")], "name string, name_repo string")
    assert readers.resolve_repo_columns(both).columns == ["name", "name_repo"]


def test_labels(spark, tmp_path):
    labels = spark.createDataFrame([(i, c) for i, c in enumerate(["11", "21", "22"])], "label int, code string")
    writers.write_labels(labels, str(tmp_path / "m" / "labels"))
    assert values(writers.load_labels(spark, str(tmp_path / "m")), "label") == [(0, "11"), (1, "21"), (2, "22")]
    with pytest.raises(FileNotFoundError):
        writers.load_labels(spark, str(tmp_path / "none"))
    maps = {"label2id": {"11": 0, "62": 10}, "id2label": {"0": "11", "10": "62"}}
    (tmp_path / "label_mappings.json").write_text(json.dumps(maps, indent=2))
    assert values(writers.load_labels(spark, str(tmp_path / "label_mappings.json")), "label") == [(0, "11"), (10, "62")]


def test_shared_folder(spark):
    assert paths.shared_folder(spark, "x") != paths.shared_folder(spark, "x")
    assert [paths.suffix(p) for p in ("a/b.csv", "s3://x.y/dir", "z.PARQUET/")] == ["csv", "", "parquet"]


def test_stored_report(spark, tmp_path):
    one = spark.createDataFrame([(1.0,)], "f1 double")
    writers.write_report(one, one, one, str(tmp_path / "rep"))
    assert set(readers.read_report(spark, str(tmp_path / "rep"))) == {"metrics", "classes", "test_size"}


def test_store_cuts_lineage(spark):
    stored = paths.store(spark.range(5).toDF("x"), "t")
    assert stored.count() == 5 and paths.shared_folder(spark, "t").split("/")[-1].startswith("sectorscope-t-")


def test_csv_keeps_blanks_and_binds_by_name(spark, tmp_path):
    rows = [("  lead", 1), ("tail  ", 2), ("x\n y ", 3), ("\t", 4)]
    df = spark.createDataFrame(rows, "t string, k int")
    writers.write_csv(df, str(tmp_path / "a.csv"))
    back = readers.read_csv(spark, str(tmp_path / "a.csv"), "k int, t string")
    assert back.dtypes == [("k", "int"), ("t", "string")]
    assert sorted((r.t, r.k) for r in back.collect()) == sorted(rows)
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "missing string")
    (tmp_path / "b.csv").write_text("description,code\nd1,52\n")
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), "code string, description string", multi_line=False).first().code == "52"


def test_broken_lines_are_counted_on_the_way(spark, tmp_path):
    lines = ['{"repo_nwo": "a", "created_at": "2025-01-01T00:00:00Z"}', '{"repo_nwo": "b", "created_at": "soon"}', "{broken", ""]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    events, seen = readers.observed_events(spark, str(tmp_path / "e.jsonl"))
    assert sorted(str(r["repo_nwo"]) for r in events.collect()) == ["None", "a", "b"]
    assert seen.get == {"n_lines": 3, "n_broken": 2}
    with pytest.raises(FileNotFoundError):
        readers.observed_events(spark, str(tmp_path / "none.jsonl"))


def test_tools_in_one_scan(spark, tmp_path):
    """The tool follows from the file: names with blanks, plus and percent, folders, shared and missing files."""
    folder = tmp_path / "a b+c%41"
    folder.mkdir()
    (folder / "x y.jsonl").write_text('{"repo_nwo": "r1"}\n')
    spark.createDataFrame([("r2",), ("r3",)], "repo_nwo string").repartition(2).write.json(str(folder / "many"))
    load = readers.event_reader(spark)
    paths = {"one": str(folder / "x y.jsonl"), "two": str(folder / "many"), "again": str(folder / "x y.jsonl"), "no": str(folder / "none")}
    rows, missing = readers.read_tools(dict.fromkeys(paths, load), paths)
    assert missing == ["no"]
    assert values(rows.select("tool", "repo_nwo"), "tool", "repo_nwo") == [("again", "r1"), ("one", "r1"), ("two", "r2"), ("two", "r3")]
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("json") == 1
    assert readers.read_tools({}, {}) == (None, [])


def test_named_number_of_partitions(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert readers.read_parquet(spark, str(tmp_path / "t.parquet")).rdd.getNumPartitions() == 1
    assert readers.read_parquet(spark, str(tmp_path / "t.parquet"), partitions=5).rdd.getNumPartitions() == 5
