"""Small tables with everything that may go wrong in them."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from samples import CLASHES, DOCS, VECTORS, edited, prose  # noqa: E402


def odd_documents() -> list[tuple]:
    base, passage = prose(1, 300), prose(2, 60, per_line=100)
    rows = [
        (1, base, "en", "src0", 1),
        (2, base, "en", "src0", 1),
        (3, edited(base, 3, 3), "en", None, 1),
        (4, edited(base, 4, 4), None, "src1", 1),
        (5, None, "en", "src0", None),
        (6, "", "en", "src0", 0),
        (7, " \t\n\x0b\x0c\r ", "en", "src0", 7),
        (8, "one", "en", "src0", 3),
        (9, "One", "en", "src0", 3),
        (10, "a b c", "en", "src0", 5),
        (11, prose(5, 100) + "\n" + passage + "\n" + prose(6, 50), "en", "src2", 1),
        (12, prose(7, 80) + "\n" + passage + "\n" + prose(8, 120), "en", "src2", 1),
        (13, prose(9, 6_000, vocabulary=5_000), "en", "src2", 1),
        (14, "x " * 500, "en", "src2", 1),
        (15, "y" * 100_000, "en", "src2", 1),
        (16, "# $ % & | < > * " * 40, "en", "src3", 1),
        (17, "\n\n\n" + prose(10, 90) + "\n\n", "en", "src3", 1),
        (17, "\n\n\n" + prose(10, 90) + "\n\n", "en", "src3", 1),  # repeated row
        (18, "tab\tvt\x0bff\x0ccr\rnbsp\xa0ls  end <|endoftext|> \U0001f600 ''re I'll  two   three", "en", "src3", 1),
        (19, prose(11, 70) + "\r\n" + prose(12, 70), "en", "src3", 1),
        (20, "ÀÉÎ ABC abc Ünï 123", "de", "src3", 1),
        (-5, prose(13, 200), "en", "src3", 1),
    ]
    rows += [(100 + k, "the same first line of all these here\n" + prose(200 + k, 60), "en", "hot", 1) for k in range(30)]
    return rows


def odd_vectors() -> list[tuple]:
    """Ties, repeated rows, and what is to be left out."""
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.3 / (1 + i)) for i in range(5)], k % 3) for k in range(60)]
    rows += [(100 + k, rows[0][1], 0) for k in range(40)]
    rows += [(7, rows[7][1], 1), (None, rows[8][1], 1), (200, [0.0, -0.0, 1.5, -2.25, 3.0], None)]
    inf, nan = float("inf"), float("nan")
    rows += [(300, None, 0), (301, [0.1, None, 0.1, 0.1, 0.1], 0), (302, [nan, 0.0, 0.0, 0.0, 0.0], 0)]
    rows += [(303, [0.0, inf, 0.0, 0.0, 0.0], 0), (304, [0.0, 0.0, -inf, 0.0, 0.0], 0)]
    return rows + [(305, [], 0), (306, [0.5, 0.5], 0)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = odd_documents()
    rows.append((None, prose(14, 120), "en", "src3", 1))
    rows.append((None, rows[0][1], None, None, None))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    return odd_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """A folder of tables, as the queries read them; ids as the contracts have them."""
    folder = tmp_path_factory.mktemp("odd")
    docs = odd_documents()
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    items = [
        (1, " ".join(docs[10][1].split()[20:60])),
        (2, "One"),
        (3, "Tab vt, FF"),
        (4, None),
        (5, "... !"),
        (6, " ".join(docs[10][1].split()[20:60])),  # the same text under another id
        (10, docs[11][1][:300].upper()),
        (11, "not in any document of these tables at all whatever happens here"),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    turns = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "a" * 1000 + "\\"),
        (1, 1, "assistant", "b"),
        (1, 2, None, None),
        (2, 5, "assistant", None),
        (2, 1, "sys\ntem", "</turn> ### \\ \\### é\U0001f600"),
        (3, 0, "assistant", "### user\nx</turn>\n### assistant\ny"),
        (3, None, "user", "no turn"),
        (None, 0, "assistant", "no conversation"),
        (2, 5, "assistant", None),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    pages = [
        (1, "http://a/ b\r\n%", "<p>é</p>"),
        (2, None, "<p>é</p>"),
        (3, "u", None),
        (4, "u", ""),
        (9, "u", "x" * 200_000),
        (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
        (8, "u", "<p>é</p>"),
        (-1, "u", "\r\n\r\n"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(odd_vectors(), VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in {
        "documents": DOCS,
        "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string",
        "pages": "page_id long, url string, html string",
        "embeddings": VECTORS,
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
