import corpus_pipeline as pipeline
import pytest

from __spark_entry__ import queries


def test_stages(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, odd_dir)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.collect()})
    rules, lines, near, clean = kept
    assert not {5, 6, 7, 8, 14, 15} & rules and {1, 2, 3, 4, 11, 12, 13, 17, -5} <= rules
    assert lines == rules
    assert {1, 2, 3, 4} & near == {1} and {11, 12, 13} <= near
    assert not {11, 12} & clean and {1, 13, -5} <= clean


def test_run(spark, odd_dir, empty_dir):
    rows = queries()["pipeline"](spark, odd_dir).collect()
    assert {1, 13, -5} <= {r.doc_id for r in rows}
    assert pipeline.run(spark, empty_dir).collect() == []


def test_names():
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    with pytest.raises(KeyError):
        queries()["no such query"]
