"""Line dedup, substring dedup, quality rules, decontamination and shards."""

import random
import re

import pytest
from samples import edited, prose

from sectorscope.llm import decontaminate, line_dedup, quality, sharding, substring_dedup

DOC = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def late_lines(docs, min_words):
    """Lines with an earlier line within one edit, by comparing all pairs."""
    lines = []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) >= min_words:
                lines.append((doc_id, k, words))
    out = {}
    for n, (doc_id, k, words) in enumerate(lines):
        if any(abs(len(words) - len(w)) < 2 and distance(words, w) < 2 for _, _, w in lines[:n]):
            out.setdefault(doc_id, set()).add(k)
    return out


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(3, 12))) for _ in range(40)]
    docs = []
    for doc_id in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                place, what = rng.randrange(len(words)), rng.randrange(3)
                words[place : place + (what != 1)] = [f"e{rng.randrange(4)}"] if what else []
                words = words or ["w"]
            lines.append(" ".join(words))
        docs.append((doc_id * 13 % 61, "\n".join(lines)))
    frame = spark.createDataFrame(docs, DOC)
    got = {r._id: {x.line for x in r.lines} for r in line_dedup.removed_lines(frame, 4).collect()}
    assert got == late_lines(docs, 4)


def test_report_loses_every_late_line(spark):
    """Against all pairs: whole copies, own repeats, equal short lines; trivial lines and one-edit short ones stay."""
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 9))) for _ in range(30)] + ["}", "{ }", "去年四月份"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for k in range(50)]
    docs += [(90, docs[3][1]), (91, "own line\n" * 50), (92, None), (93, "")]
    lines = [(d, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n"))]
    late, earlier = late_lines(docs, 6), set()
    for d, k, x in lines:
        words = tuple(x.lower().split())
        if 0 < len(words) < 6 and len(x.strip()) >= 4:
            if words in earlier:
                late.setdefault(d, set()).add(k)
            earlier.add(words)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in late.get(d, ())) for d, t in docs if t is not None}
    rows = line_dedup.line_report(spark.createDataFrame(docs, DOC).repartition(4)).collect()
    assert {r.doc_id: r.kept_text for r in rows if r.doc_id != 92} == want and want[90] == "" and want[91] == "own line\n"
    assert all(r.n_removed == len(late.get(r.doc_id, ())) for r in rows)


def test_words_within_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(7))] for _ in range(2))
        assert line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1)


def test_copies_are_left_whole_and_columns_kept(spark, clashing, no_docs):
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    given = {r.doc_id: r.text for r in clashing.collect()}
    assert texts[1] == given[1] and texts[2] == given[2]  # a copy would lose everything
    assert texts[5] is None and texts[13] == given[13]
    assert texts[100] == given[100] and texts[101] == given[101].split("\n", 1)[1]
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_very_long_lines(spark):
    docs = spark.createDataFrame([(1, "x " * 30_000), (2, "x " * 29_999), (3, "y" * 10**6 + " a b c d e f")], DOC)
    rows = {r.doc_id: r.n_removed for r in line_dedup.line_report(docs, max_loss=1.0).collect()}
    assert rows == {1: 0, 2: 1, 3: 0}


def repeats(docs, window):
    texts = [(d, (t or "").encode().split()) for d, t in docs]
    count = {}
    for _, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,letters", [(35, 400), (6, 2), (9, 3), (1, 50)])
def test_repeats_against_all_windows(spark, window, letters):
    rng = random.Random(window)
    shared = [prose(k, 70, letters) for k in range(4)]
    docs = []
    for k in range(80):
        parts = [prose(1000 + k, rng.randrange(60), letters)]
        for _ in range(rng.randrange(3)):
            parts.append(edited(rng.choice(shared), k, rng.randrange(3)))
            parts.append(prose(2000 + k, rng.randrange(30), letters))
        docs.append((k, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, docs[0][1]), (93, " \n")]
    frame = spark.createDataFrame(docs, DOC)
    rows = substring_dedup.remove_repeats(frame, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == repeats(docs, window)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in rows)


def test_repeats_of_odd_rows(odd_docs, clashing, no_docs):
    want = repeats([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], 35)
    for docs in (odd_docs, clashing):
        rows = substring_dedup.remove_repeats(docs).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == want
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_repeats_with_hot_anchors(spark, monkeypatch):
    """A passage in every document, in copies and in contexts of its own, through salted joins."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(substring_dedup, "SALTS", 5)
    passage, long = prose(400, 12), prose(401, 60)
    docs = [(k, f"{prose(3000 + k, 15)} {passage} {prose(4000 + k, 15)}") for k in range(60)]
    docs += [(100 + k, long) for k in range(40)] + [(200 + k, f"{long} {prose(5000 + k, k)}") for k in range(40)]
    docs += [(None, long), (7, None), (8, docs[8][1])]
    frame = spark.createDataFrame(docs, DOC).repartition(6)
    found = substring_dedup._hot_anchors(substring_dedup._seeds(frame, 9).groupBy("h").count().withColumnRenamed("count", "c"))
    assert found
    rows = substring_dedup.remove_repeats(frame, 9).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == repeats(docs, 9)


def test_quality_keeps_clean_documents(spark, clashing, no_docs):
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 3, 4, 11, 12, 13, 17, 100, 129} <= ids and not {5, 6, 7, 8, 14, 15} & ids
    assert quality.keep_good(no_docs).collect() == []


def test_frequent_lines_deplete(spark):
    """Documents of little but lines of their host go, all but the first; copies count once."""

    def letters(seed, words):  # digits are all alike in a normalised line
        return prose(seed, words).translate({ord("0") + k: ord("a") + k for k in range(10)})

    menu = "\n".join(letters(k, 12) for k in range(10))
    rows = [(k, f"{menu}\n{letters(100 + k, 10)}", "a") for k in range(40)]
    rows += [(100 + k, letters(500 + k, 80) + "\n" + menu.split("\n")[0], "a") for k in range(40)]
    copies = letters(9, 100)
    rows += [(300 + k, copies, "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert [k for k in range(40) if verdict[k].kept] == [0]
    assert all(verdict[k].kept for k in [*range(100, 140), *range(300, 360)])
    assert verdict[105].frequent_chars > 0 and verdict[305].frequent_chars == 0


def frequent_line_verdicts(docs, limit, max_loss):
    """Per row: frequent characters, whether it is depleted, and the text that is left; in plain Python."""

    def lines(text):
        return [re.sub("[0-9]+", "0", x.lower()).strip(" ") for x in (text or "").split("\n")]

    carriers = {}
    for doc_id, text, host in docs:
        for x in set(lines(text)):
            if x.strip():
                carriers.setdefault((host, x), {}).setdefault(text, []).append(doc_id)
    first = {k: min((i for own in v.values() for i in own if i is not None), default=None) for k, v in carriers.items() if len(v) > limit}
    out = []
    for doc_id, text, host in docs:
        own = lines(text)
        gone = [bool((host, x) in first and doc_id != first[host, x]) for x in own]
        lost = sum(len(x) for x, g in zip(own, gone) if g)
        total = sum(len(x) for x in own if x.strip())
        left = "\n".join(x for x, g in zip((text or "").split("\n"), gone) if not g)
        out.append((doc_id, lost, lost > max_loss * total, left))
    return out


def test_frequent_lines_against_plain_counts(spark):
    """Lines of few and of many documents, digits apart, hosts, copies, null ids and hosts, ties."""
    rng = random.Random(12)
    pool = [f"{prose(k, 6)} {k}" for k in range(12)]
    docs = []
    for k in range(150):
        own = prose(7000 + k, 20)
        menu = [re.sub("[0-9]+", str(rng.randrange(99)), x) + " " * rng.randrange(2) for x in rng.sample(pool, rng.randrange(10))]
        docs.append((k if k % 9 else None, "\n".join([own if k % 3 else "", *menu]), rng.choice(["a", "b", None])))
    docs += [(500 + k, docs[5][1], docs[5][2]) for k in range(30)] + [(600, None, "a"), (601, "", "a"), (3, docs[3][1], docs[3][2])]
    docs.append((700, " ".join(f"long{k}" for k in range(40_000)) + "\n" + pool[0], "a"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    limits = {"min_words": 0, "max_repeat_percent": 100, "max_line_docs": 7, "max_loss": 0.5}
    want = frequent_line_verdicts(docs, 7, 0.5)
    got = quality.quality_rules(frame, **limits).collect()
    assert sorted(((r.doc_id, r.frequent_chars, not r.kept) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert any(w[1] for w in want) and any(w[2] for w in want) and not all(w[2] for w in want)
    left = quality.clean_good(frame, **limits).collect()
    assert sorted(((r.doc_id, r.text or "") for r in left), key=str) == sorted(((w[0], w[3]) for w in want if not w[2]), key=str)


def test_both_ways_to_find_repeated_windows(spark):
    rng = random.Random(4)
    docs = [(k, [rng.randrange(4 + k % 9) for _ in range(rng.randrange(60))]) for k in range(60)]
    frame = spark.createDataFrame(docs, "k long, w array<long>")
    both = frame.select("k", quality.covered_by_repeats(frame.w, 3, 256).alias("a"), quality.covered_by_repeats(frame.w, 3, 1).alias("b"))
    for r in both.collect():
        values = docs[r.k][1]
        marked = {i + j for i, v in enumerate(values) if values.count(v) > 1 for j in range(3)}
        assert r.a == r.b == len(marked)


def test_decontamination_in_blocks(spark, clashing, odd_dir, no_docs):
    items = spark.read.parquet(f"{odd_dir}/benchmark.parquet")

    def rows(docs, **limits):
        found = decontaminate.find_contamination(docs, items, **limits).drop("_key")
        return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.items), sorted(map(tuple, r.spans))) for r in found.collect()), key=str)

    assert rows(clashing) == rows(clashing, block=7)
    kept = decontaminate.keep_uncontaminated(clashing, items)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not {8, 9, 11, 12, 18} & ids and {1, 2, 13, 100} <= ids
    assert rows(no_docs) == []


def test_shards(spark, clashing, no_docs, tmp_path):
    rows = sharding.assign_shards(clashing, 4000).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for shard, members in by_shard.items():
        total = sum(r.n_bytes for r in members)
        assert {r.shard_bytes for r in members} == {total} and (total <= 4000 or len(members) == 1)
        assert not any(other != shard and other.startswith(shard) for other in by_shard)
    sharding.write_shards(clashing, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == clashing.count() and set(clashing.columns) <= set(back.columns)
    assert sharding.assign_shards(no_docs).collect() == []


def test_equal_rows_over_the_limit_split(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 200 + [(2, "y" * 50_000)], DOC).repartition(3)
    rows = sharding.assign_shards(docs, 1000).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        assert r.over_limit == (r.doc_id == 2)
    assert len(rows) == 201 and sorted(sizes.values())[-2] <= 1000


def test_late_lines_go_whatever_their_share(spark):
    """Repeats inside a text and lines of several documents; a near copy of one document stays whole."""
    first, second = prose(71, 240), prose(72, 240)
    own = prose(73, 12, vocabulary=9000)
    mixed = "\n".join([*first.split("\n")[:8], *second.split("\n")[:8], own])
    part = "\n".join(first.split("\n")[:6])
    near = first + "\n" + prose(74, 12, vocabulary=9000)
    line = "a text that repeats its own line"
    rows = [(1, first), (2, second), (3, mixed), (4, "\n".join([line] * 1000)), (5, part), (6, near), (6, near), (None, first)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    texts = {r.doc_id: r.text for r in out}
    assert len(out) == len(rows)
    assert (texts[1], texts[2], texts[3], texts[4], texts[5]) == (first, second, own, line, "")
    assert texts[6] == near and texts[None] == first


def test_frequent_lines_leave_the_text(spark, clashing, no_docs):
    def letters(seed):
        return prose(seed, 80).translate({ord("0") + k: ord("a") + k for k in range(10)})

    menu = "Home  About\tNews 12"  # equal to the others once digits are alike
    rows = [(k, f"{menu}{k} \n\n{letters(800 + k)}\n", "a", -1) for k in range(30)]
    rows += [(30, letters(900), "a", -1), (31, f"{menu}\n{letters(901)}", "b", -1), (32, None, "a", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in quality.clean_good(docs).collect()}
    assert out[0] == rows[0][1::2] and out[30] == rows[30][1::2] and out[31] == rows[31][1::2] and 32 not in out
    for k in range(1, 30):
        text = rows[k][1].split("\n", 1)[1]
        assert out[k] == (text, len(text))
    cleaned = quality.clean_good(clashing)
    texts, given = ({r.doc_id: r.text for r in d.collect()} for d in (cleaned, clashing))
    assert cleaned.columns == clashing.columns and set(texts) == {r.doc_id for r in quality.keep_good(clashing).collect()}
    assert texts[100] == given[100] and texts[1] == given[1]
    assert [k for k in range(100, 130) if "the same first line" in texts.get(k, "")] == [100]
    assert quality.clean_good(no_docs).collect() == []


def test_documents_that_differ_in_digits_are_counted(spark):
    """Template pages are many documents, exact copies one, and a large host has the same limit."""
    rng = random.Random(6)
    names = [prose(k, 8).translate({ord("0") + k: ord("a") + k for k in range(10)}) for k in range(8)]
    pages = ["\n".join(f"{name} {rng.randrange(10**6)}" for name in names) for _ in range(40)]
    rows = [(k, page, "a") for k, page in enumerate(pages)]
    rows += [(100 + k, pages[0], "b") for k in range(40)]
    menu = "\n".join(names)
    rows += [(1000 + k, f"{menu}\nx{k}", "c") for k in range(30)]
    rows += [(2000 + k, prose(k, 60).translate({ord("0") + i: ord("a") + i for i in range(10)}), "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = {r.doc_id for r in quality.clean_good(docs).collect()}
    assert sorted(ids) == [0, *range(100, 140), 1000, *range(2000, 2300)]


def test_equal_lines_of_few_words(spark):
    """A line without blanks and menu lines go where they are equal; one edit is for longer lines."""
    line = "".join(chr(0x4E00 + k * 7) for k in range(300))
    rows = [(k, f"{prose(950 + k, 60)}\n{line}\nAll rights reserved.\n}}\n去年四") for k in range(4)]
    rows += [(9, f"{prose(960, 60)}\n{line[:-1]}\nAll rights\n ALL  rights reserved.\t")]
    docs = spark.createDataFrame(rows, DOC)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert texts[0] == rows[0][1]
    assert all(texts[k] == f"{prose(950 + k, 60)}\n}}\n去年四" for k in range(1, 4))
    assert texts[9] == f"{prose(960, 60)}\n{line[:-1]}\nAll rights"


def test_lines_and_halves_are_hashed_in_one_pass(spark):
    """Halves come from the stored places, so that texts are read once for both."""
    text = "a b c d e f\nshort line\na b c x y z\nq r s d e f\na b c d e f g"
    places = line_dedup._line_places(spark.createDataFrame([(1, text), (2, None), (3, "a b c d e f")], DOC), 6)
    keys = {}
    for r in line_dedup._line_halves(places).collect():
        keys.setdefault((r.side, r.key), set()).add(r.h)
    line = {r.line: r.h for r in places.where("_id = 1").collect()}
    assert sorted(line) == [0, 2, 3, 4] and {r.h for r in places.where("_id = 3").collect()} == {line[0]}
    shared = sorted((side, sorted(h)) for (side, _), h in keys.items() if len(h) > 1)
    # Of 3 words, and of 2 among lines of 6 words.
    first = [(line_dedup.PREFIX, sorted(line[k] for k in some)) for some in ((0, 2, 4), (0, 2))]
    assert shared == sorted([*first, *[(line_dedup.SUFFIX, sorted([line[0], line[3]]))] * 2])
    assert sorted(len(r.halves) for r in places.collect()) == [2, 4, 4, 4, 4]
