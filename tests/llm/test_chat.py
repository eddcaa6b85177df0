import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from sectorscope.llm import chat
from sectorscope.llm.queries.chat import conversation_log

LOG = "conv_id long, seq long, message long, kind string, role string, text string"
PARTS = ["\\", "#", "</turn>", "###", "\n", "a", " ", "é", "### Assistant:", "\U0001f600"]
nasty = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@given(st.lists(st.tuples(nasty, nasty), max_size=5))
def test_escapes_are_reversible(turns):
    text = "".join(chat.render_turn(r, t) for r, t in turns)
    assert list(chat.parse_turns(text)) == turns


def fold(events):
    """Messages of one conversation, event by event in order of sequence."""
    state = {}
    for seq, message, kind, role, text in sorted({e[0]: e for e in sorted(events, key=str, reverse=True)}.values()):
        if kind == "start":
            state[message] = [seq, role or "", text or ""]
        elif message in state and kind == "delta":
            state[message][2] += text or ""
        elif message in state and kind == "edit":
            state[message][2] = text or ""
        elif kind == "regenerate":
            if message in state:
                state[message][2] = text or ""
            state = {m: s for m, s in state.items() if m <= message}
    return [(m, s[1], s[2]) for m, s in sorted(state.items())]


def test_reconstruction(spark):
    rng, rows, want = random.Random(3), [], []
    for conv in range(60):
        events = []
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["start", "start", "delta", "delta", "delta", "edit", "regenerate"])
            events.append((seq, rng.randrange(5), kind, rng.choice(["user", "assistant"]), rng.choice(["a", "bc", "", None])))
        want += [(conv, *m) for m in fold(events)]
        rows += [(conv, *e) for e in events] + [(conv, *rng.choice(events)) for _ in range(3)]  # delivered twice
        rows += [(conv, 99, 0, "unknown", "user", "x"), (conv, 98, 0, None, "user", "x"), (conv, None, 0, "edit", "u", "x")]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, LOG).repartition(4)
    got = sorted((r.conv_id, r.message, r.role, r.text) for r in chat.reconstruct(log).collect())
    assert got == sorted(want)


def test_one_conversation_with_everything(spark):
    log = spark.createDataFrame(
        [
            (1, 1, 1, "start", "user", "hello"),
            (1, 2, 2, "start", "assistant", "he"),
            (1, 3, 2, "delta", None, "y"),
            (1, 4, 3, "start", "user", "taken back"),
            (1, 5, 2, "regenerate", None, None),
            (1, 6, 2, "delta", None, "better ###"),
            (1, 7, 3, "start", "user", "next"),
            (1, 8, 1, "edit", None, "hello!"),
            (None, 1, 1, "start", None, None),
        ],
        LOG,
    )
    rows = sorted(chat.format_conversations(log).collect(), key=lambda r: (str(r.conv_id), r.part))
    text = "".join(r.formatted for r in rows if r.conv_id == 1)
    assert list(chat.parse_turns(text)) == [("user", "hello!"), ("assistant", "better ###"), ("user", "next")]
    spans = [(r.loss_begin, r.loss_end) for r in rows if r.conv_id == 1 and r.loss_begin is not None]
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["better ###"]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(log)).collect()}
    assert back[1].loss_sha256 == hashlib.sha256(b"better ###").hexdigest()
    assert back[1].n_turns == 3 and back[1].formatted_chars == len(text) and back[None].n_turns == 1


def test_derived_log_leads_to_the_table(spark):
    """All kinds of events occur, some twice, and the table comes back; extra columns do not clash."""
    rng = random.Random(8)
    texts = ["", None, "short", "\U0001f600" * 700, "x" * 256, "y" * 257, "a\nb\n" * 3000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), c, "edit") for c in range(60) for t in range(c % 9)]
    rows += [(None, 0, "user", "hello", 1, "start"), (5, 0, "user", "tie", 1, ""), (5, 0, "user", "tie", 2, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq long, kind string")
    log = conversation_log(table.repartition(3))
    events = log.collect()
    assert {e.kind for e in events} == {"start", "delta", "edit", "regenerate"}
    assert len({(e.conv_id, e.seq) for e in events}) < len(events)
    by_conv = {}
    for e in events:
        by_conv.setdefault(e.conv_id, []).append((e.seq, e.message, e.kind, e.role, e.text))
    want = sorted(((c, m, r, t) for c, own in by_conv.items() for m, r, t in fold(own)), key=str)
    got = sorted((tuple(r) for r in chat.reconstruct(log).collect()), key=str)
    assert got == want
    said = sorted(((c, r or "", t or "") for c, _, r, t, _, _ in rows), key=str)
    assert sorted(((c, r, t) for c, _, r, t in got), key=str) == said
    assert conversation_log(table.limit(0)).collect() == []
