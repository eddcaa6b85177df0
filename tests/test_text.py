"""Golden rows of the text expressions."""

import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from sectorscope.functions import text as tx
from sectorscope.operators import classify, corpus


def apply(spark, inputs, expr, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


CLEAN = [
    ("[![b](https://x.y/z.svg)](https://ci.com/a) hi", "[](ci.com hi"),
    ("Repository: a_b | README: # Title\n## Sub\n```python\nx=1\n```\nend", "Repository: ab | README: # Title Sub python x=1 end"),
    ("see https://x.com/a) and https://y.com) ok", "see x.com and y.com) ok"),
    ("pip install foo\nThen docs\nmore", ""),
    ("LGPL\nMIT License\nMIT License is used\nCopyright 2020 me\nrest", "LMIT License is used rest"),
    ("node.js Node py3 py js ReactJS!!! ?? .....", "nodejs.javascript nodejs py3 python javascript react! ? ..."),
    ("a\rCopyright x\ry\nz", "a z"),
    ("x\n#\n\n# y", "x y"),
    ("   GPL\n", ""),
    ("tail Copyright z\n", "tail"),
    ("\xa0lead\xa0", "lead"),
    (None, ""),
    ("", ""),
    ("a b c\x1cd\x85e", "a b c d e"),
    # letters outside the basic plane and numbers belong to a word, marks and joiners end it
    ("\U0001d400js ²js js½", "\U0001d400js ²js js½"),
    ("jś a‍js", "javascript́ a‍javascript"),
    ("....!!?? a..b", "...!? a..b"),
    ("use GIT Clone x and more", "use"),
    ("  many   words\t\there ", "many words here"),
    ("![a](b) ![c](d)![e](f)x", "x"),
    ("MIT LICENSE\napache license\nbsd", ""),
    ("http://host/path?q#f tail", "host tail"),
]


@pytest.mark.parametrize("raw, cleaned", CLEAN)
def test_clean_readme(spark, raw, cleaned):
    assert apply(spark, [raw], tx.clean_readme) == [cleaned]


def test_character_classes_equal_python(spark):
    """Whitespace and ignored case over all code points, word characters over the settled ones."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    chars = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string").cache()

    def matching(pattern):
        return {r.c for r in chars.where(F.rlike("t", F.lit(pattern))).select("c").collect()}

    assert matching(rf"(?U)[{tx.WS}]") == {c for c in points if chr(c).isspace()}
    words = {c for c in points if c < 0x860 and (chr(c).isalnum() or chr(c) == "_")}
    assert {c for c in matching(r"[\p{L}\p{N}_]") if c < 0x860} == words
    assert matching(r"(?U)^(?i:i)$") == {ord(c) for c in "iIıİ"}
    assert matching(r"(?U)^(?i:s)$") == {ord(c) for c in "sSſ"}
    chars.unpersist()


@pytest.mark.parametrize("rule, plain", [(0, r"(?d)!\[.*?\]\(.*?\)"), (1, r"(?d)\[!\[.*?\]\(.*?\)\]\(.*?\)")])
def test_linear_badge_rules_equal_the_plain_ones(spark, rule, plain):
    rng = random.Random(3)
    pieces = ["!", "[", "]", "(", ")", "![", "](", "[![", ")](", "a", "\n", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast, slow = F.regexp_replace("t", *tx.CLEANING_RULES[rule]), F.regexp_replace("t", plain, "")
    assert df.where(fast != slow).count() == 0
    assert df.where(fast != F.col("t")).count() > 100


@pytest.mark.parametrize("piece", ["![", "![a](", "[![a](b", "[![a](b)](", "](", "Copyright ", "GPL ", "# ", "js", "npm ", "."])
def test_awkward_texts_take_linear_time(spark, piece):
    """With a rule that rescans the line for every opening bracket these run for hours."""
    assert len(apply(spark, [piece * 50_000], tx.clean_readme)) == 1


def test_long_text_is_cleaned_whole(spark):
    raw = "Word js, " * 60_000 + "end"
    assert apply(spark, [raw], tx.clean_readme) == ["Word javascript, " * 60_000 + "end"]


TOPICS = [
    (None, ""),
    ("", ""),
    ("[]", ""),
    ("['a', 'b']", "a; b"),
    ('["a","b"]', "a; b"),
    ("[a, b]", "a; b"),
    ("x, y", "x; y"),
    ("[1, 'x', '']", "1; x"),
    ("[1, None, 'x']", "1; x"),
    ("['a', 'b',]", "a; b"),
    ("['it\\'s', \"q\"]", "it's; q"),
    ("['it's', 'b']", "'it's'; 'b'"),
    ("[0, 1.50, True, False]", "1.5; True"),
    ("  [a] ", "a"),
    ("['a'],['b']", "'a';'b'"),
    ("['a' 1]", "'a' 1"),
    ("['a\\\\b']", "a\\b"),
]


@pytest.mark.parametrize("raw, cleaned", TOPICS)
def test_clean_topics(spark, raw, cleaned):
    assert apply(spark, [raw], tx.clean_topics) == [cleaned]


def test_printed_lists_are_read_back(spark):
    """Any printed list of texts, numbers and constants gives its true elements."""
    rng = random.Random(1)
    letters = "ab'\"\\,[]; \n\t\r-_éü\x1c\x7f\u200b 😀x0n"

    def element():
        if rng.random() < 0.2:
            return rng.choice([None, True, False, 0, 7, -3, 1.5, ""])
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))

    lists = [[element() for _ in range(rng.randint(0, 5))] for _ in range(1000)]
    got = apply(spark, [str(items) for items in lists], tx.clean_topics)
    assert got == ["; ".join(str(x) for x in items if x) for items in lists]


def test_topics_from_array(spark):
    got = apply(spark, [["a", "", None], [], None, ["x", "y"]], lambda c: tx.clean_topics(c, True), "array<string>")
    assert got == ["a", "", "", "x; y"]


def test_long_topic_list(spark):
    items = [f"t{i}" for i in range(20_000)]
    assert apply(spark, [str(items)], tx.clean_topics) == ["; ".join(items)]


def test_first_words(spark):
    assert apply(spark, ["  a b\n\nc d ", "a", "", None], lambda c: tx.first_words(c, 3)) == ["a b c", "a", "", None]


def test_tokens(spark):
    assert apply(spark, [" The  Quick\nfox ", ""], lambda c: tx.tokens(c, 2)) == [["the", "quick"], []]
    assert tx.token_limit(2048) == 512
    assert tx.token_limit(9000, long_context=True) == 8192
    assert tx.token_limit(300) == 300


def test_tokenize_renames_label(spark):
    df = spark.createDataFrame([("a b", 3)], "text string, label int")
    assert classify.tokenize(df, 5).columns == ["labels", "tokens"]


def test_preview_and_percent(spark):
    assert apply(spark, ["x" * 100, "x" * 101], tx.preview) == ["x" * 100, "x" * 100 + "..."]
    df = spark.createDataFrame([(0.9368,)], "c double")
    assert df.select(tx.percent(F.col("c"))).first()[0] == "93.68%"


REPO = "name_repo string, description string, topics string, readme_content string"


def test_formatters_differ_on_empty_and_nan(spark):
    df = spark.createDataFrame([("r", "", None, "w"), ("r", "nan", None, "nan"), (None, None, " ", None)], REPO)
    train = [r[0] for r in df.select(corpus.training_text_column(df)).collect()]
    simple = [r[0] for r in df.select(corpus.simple_text_column(df)).collect()]
    batch = [r[0] for r in df.select(corpus.batch_text_column(df)).collect()]
    assert train == ["Repository: r | Description: | README: w", "Repository: r | Description: nan | README: nan", ""]
    assert simple == ["Repository: r | README: w", "Repository: r | Description: nan | README: nan", "Topics:  "]
    assert batch == ["Repository: r | README: w", "Repository: r", ""]


def test_only_batch_text_cuts_readme(spark):
    df = spark.createDataFrame([("r", None, None, "x" * 5001)], REPO)
    cut = df.select(
        F.length(corpus.batch_text_column(df)), F.length(corpus.training_text_column(df)), F.length(corpus.simple_text_column(df))
    ).first()
    head = len("Repository: r | README: ")
    assert tuple(cut) == (head + 5000, head + 5001, head + 5001)


def test_batch_topics(spark):
    df = spark.createDataFrame([("r", "['a', 'b']"), ("r", "[]"), ("r", "[ ]"), ("r", None)], "name string, topics string")
    got = [r[0] for r in df.select(corpus.batch_text_column(df)).collect()]
    assert got == ["Repository: r | Topics: a; b", "Repository: r", "Repository: r", "Repository: r"]
    listed = spark.createDataFrame([("r", ["a", "", None]), ("r", [])], "name string, topics array<string>")
    got = [r[0] for r in listed.select(corpus.batch_text_column(listed)).collect()]
    assert got == ["Repository: r | Topics: a", "Repository: r"]


def test_name_falls_back_to_repo(spark):
    df = spark.createDataFrame([(None, "x"), ("n", "x")], "name_repo string, repo string")
    assert values(df.select(corpus.training_text_column(df))) == [("Repository: x",), ("Repository: n",)]


def test_readme_word_limit(spark):
    df = spark.createDataFrame([("r", None, None, "a b\nc d")], REPO)
    assert df.select(corpus.training_text_column(df, max_readme_words=2)).first()[0] == "Repository: r | README: a b"
    assert df.select(corpus.training_text_column(df, clean=False)).first()[0] == "Repository: r | README: a b\nc d"


def test_topics_with_marks_and_exponents(spark):
    rows = [("[\x01]",), ("['a', \x01]",), ("[1e3]",), ("[2.5, 'b']",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(tx.clean_topics(F.col("t"))).collect()] == ["\x01", "'a'; \x01", "1000.0", "2.5; b"]


def test_runs_of_whitespace(spark):
    """Single blanks stay, every other run becomes one, as if every run were replaced."""
    from sectorscope.functions.text import WS, _SPACES

    rng = random.Random(7)
    texts = ["".join(rng.choice([" ", " ", "\t", "\n", "\r", "\u00a0", "\u2003", "\x1c", "\x85", "a", "bc"]) for _ in range(12)) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", rf"(?U)[{WS}]+", " ")
    assert rows.where(F.regexp_replace("t", *_SPACES) != plain).collect() == []
