import gzip
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sectorscope.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    pages = spark.createDataFrame(
        [(k, f"http://x/{k} é\n", None if k == 4 else "same" if k % 3 == 0 else f"page {k}" * k * 500) for k in range(30)], PAGES
    )
    warc.write_warc(warc.page_records(pages.repartition(3)), path, file_bytes=2000)
    return path


def test_round_trip_and_pushed_filters(spark, archive):
    rows = {r.page_id: r for r in warc.read_warc(spark, archive).collect()}
    assert len(rows) == 30
    assert rows[27].record_type == "response" and rows[27].payload == b"same"
    assert rows[3].refers_to_page == 27 and rows[3].refers_to == rows[27].record_id and rows[3].payload is None
    assert rows[4].payload == b"" and rows[5].target_uri == "http://x/5 é\n"
    read = warc.read_warc(spark, archive)
    revisits = read.where("record_type = 'revisit'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source took it
    assert revisits.count() == 9
    assert read.where("page_id in (1, 2) and record_type = 'response'").count() == 2
    assert warc.read_warc(spark, archive, types=["revisit"]).count() == 9
    assert read.where("payload_length > 100").count() == read.collect().__len__() - sum(
        (r.payload_length or 0) <= 100 for r in rows.values()
    )


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    asked = []
    body = warc._Member.body
    monkeypatch.setattr(warc._Member, "body", lambda self, *a: asked.append(a) or body(self, *a))
    noise = random.Random(1).randbytes(1_000_000)
    data = b"".join(warc.gzip_member(warc.record_bytes(_record(k, noise))) for k in range(5))
    source = Counting(data)
    rows = list(warc.read_records(io.BufferedReader(source, 1024), [("page_id", {3})], True))
    assert [r[6] for r in rows] == [3] and rows[0][-1] == noise and len(asked) == 1
    read_all = Counting(data)
    list(warc.read_records(io.BufferedReader(read_all, 1024), [], True))
    assert source.read_bytes < read_all.read_bytes


class Counting(io.BytesIO):
    read_bytes = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.read_bytes += n
        return n


def _record(k, payload):
    return {"record_type": "response", "record_id": f"r{k}", "page_id": k, "payload": payload, "payload_length": len(payload)}


@pytest.mark.parametrize("wrap", ["plain", "members", "one member each"])
def test_files_of_other_writers(wrap):
    records = [warc.record_bytes(_record(k, b"WARC/1.1\r\n\r\n" * k)) for k in range(4)]
    extra = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nX-Long: a\r\n b\r\n\r\nhello\r\n\r\n"
    data = b"".join([extra, *records]) if wrap == "plain" else b"".join(gzip.compress(r) for r in [extra, *records])
    rows = list(warc.read_records(io.BufferedReader(io.BytesIO(data)), [], True))
    assert [r[-1] for r in rows] == [b"hello", *[b"WARC/1.1\r\n\r\n" * k for k in range(4)]]
    skipped = list(warc.read_records(io.BufferedReader(io.BytesIO(data)), [("page_id", {2})], False))
    assert [r[6] for r in skipped] == [2] and skipped[0][-1] is None


def test_broken_files_say_so():
    data = warc.record_bytes(_record(1, b"x" * 100))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BufferedReader(io.BytesIO(data[:40])), [], True))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BufferedReader(io.BytesIO(data[:-60])), [], True))


def test_a_failed_write_leaves_no_record(spark, tmp_path):
    path = str(tmp_path / "b")
    records = warc.page_records(spark.createDataFrame([(1, "u", "a")], PAGES)).withColumn(
        "payload", F.expr("if(page_id = 1, raise_error('no'), payload)").cast("binary")
    )
    with pytest.raises(Exception, match="no"):
        warc.write_warc(records, path)
    assert warc.read_warc(spark, path).count() == 0 if (tmp_path / "b").exists() else True


def test_base32(spark):
    row = spark.sql("select sha1('abc') as h").select(warc.base32(F.col("h")).alias("b"))
    assert row.first().b == warc.payload_digest(b"abc")


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbb"), (4, "u", "bbb"), (None, "u", "c")], PAGES)
    rows = {r.page_id: r.record_type for r in warc.page_records(pages, min_revisit_bytes=3).collect()}
    assert rows == {1: "response", 2: "response", 3: "revisit", 4: "response", None: "response"}


def test_very_long_payload_in_linear_time():
    """64 MB that do not compress, and 64 MB that compress very well, each read in seconds."""
    for payload in (os.urandom(64 << 20), b"a" * (64 << 20)):
        row = dict.fromkeys(warc.HEADERS) | {"record_type": "response", "payload": payload}
        data = warc.gzip_member(warc.record_bytes(row)) * 2
        start = time.time()
        found = list(warc.read_records(io.BytesIO(data), [], True))
        assert [r[-1] == payload for r in found] == [True, True]
        assert time.time() - start < 20


def test_path_as_spark_has_it(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    with pytest.raises(Exception):
        warc.qualified(spark, "nosuchscheme://host/x")
