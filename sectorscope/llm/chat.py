"""Conversations from event logs, rendered for training.

A log holds events of four kinds for the messages of a conversation:

* ``start`` opens a message with a role and its first text;
* ``delta`` adds streamed text to it;
* ``edit`` replaces the text it has so far;
* ``regenerate`` empties it, so that new deltas follow, and takes back every later message
  that was open by then (they answered a text that is gone).

Events are told apart by conversation and ``seq``; a log may deliver one more than once and in
any order.  The log is partitioned by conversation and sorted by message and sequence, and
one pass folds it as a stream: it holds the message at hand, never a conversation.  Which
messages a regeneration takes back is known before, from a running maximum over messages of
the last regeneration, which Spark keeps as a window.

Rendering writes a row for each message, in order; a conversation's text is their
concatenation::

    ### <role>
    <text></turn>

A backslash stands before every backslash, ``</turn>`` and ``###`` of a text or role and before
line ends of a role, so any text can be read back: after a backslash the next character is
itself.  The loss mask is the span of each assistant text in the conversation's text, between
the header's line end and ``</turn>``.

Null text: empty.  Null role: empty.  Null conversation: a conversation of its own.  Events
with a null or unknown kind, and events of a message that was never started, count for
nothing.  Equal (conversation, seq): one counts, the least by message, kind, role and text.
A conversation without messages gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("start", "delta", "edit", "regenerate")
HEADER, END = "### ", "</turn>"
TO_ESCAPE = re.compile(r"\\|</turn>|###")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

MESSAGES = "conv_id long, message long, role string, text string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
RENDERED = "conv_id long, part long, formatted string, begin long, loss_begin long, loss_end long"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> str:
    return f"{HEADER}{escape_role(role)}\n{escape(text)}{END}\n"


def _skip_to(text: str, mark: str, at: int) -> int:
    """Place of the first ``mark`` from ``at`` on that no backslash escapes."""
    stop = re.compile(r"\\.|" + re.escape(mark), re.DOTALL)
    while True:
        found = stop.search(text, at)
        if found is None:
            raise ValueError("A turn without its end")
        if found[0] == mark:
            return found.start()
        at = found.end()


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns in a rendered text."""
    at = 0
    while at < len(text):
        if not text.startswith(HEADER, at):
            raise ValueError("A turn without its header")
        line = _skip_to(text, "\n", at + len(HEADER))
        end = _skip_to(text, END, line + 1)
        yield unescape(text[at + len(HEADER) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def _values(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _schema(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in spec.split(", "))])


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages (``conv_id``, ``message``, ``role``, ``text``) of an event log
    (``conv_id``, ``seq``, ``message``, ``kind``, ``role``, ``text``)."""
    events = log.select(
        F.col("conv_id").cast("long"),
        F.col("seq").cast("long"),
        F.col("message").cast("long"),
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("kind").isin(*KINDS) & F.col("seq").isNotNull() & F.col("message").isNotNull())
    # One of the rows that share conversation and seq, aggregated in part before the shuffle.
    events = events.groupBy("conv_id", "seq").agg(F.min(F.struct("message", "kind", "role", "text")).alias("e"))
    events = events.select("conv_id", "seq", "e.*")
    regenerated = F.when(F.col("kind") == "regenerate", F.col("seq"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("taken_back", F.max(regenerated).over(earlier))
    # The window's partitioning serves the stream as well.
    ordered = events.sortWithinPartitions("conv_id", "message", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, parts = None, None, []
        for batch in batches:
            out = []
            for conv, message, seq, kind, who, text, cut in _values(
                batch, "conv_id", "message", "seq", "kind", "role", "text", "taken_back"
            ):
                if (conv, message) != now:
                    if role is not None:
                        out.append((*now, role, "".join(parts)))
                    now, role, parts = (conv, message), None, []
                if kind == "start":
                    # Opened before an earlier message was regenerated: taken back.
                    role, parts = (None, []) if cut is not None and seq < cut else (who, [text])
                elif role is not None and kind == "delta":
                    parts.append(text)
                elif role is not None:
                    parts = [text]
            yield _batch(out, _schema(MESSAGES))
        if role is not None:
            yield _batch([(*now, role, "".join(parts))], _schema(MESSAGES))

    return ordered.mapInArrow(fold, MESSAGES)


def render(messages: DataFrame) -> DataFrame:
    """A row for each message: ``conv_id``, ``part`` (0, 1, ...), ``formatted``, where it begins
    in the conversation's text, and its loss span there (null but for assistants).

    One shuffle by conversation; a stream that holds one message.
    """
    rows = messages.select("conv_id", "message", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "message", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, at = None, 0, 0
        for batch in batches:
            out = []
            for conv, role, text in _values(batch, "conv_id", "role", "text"):
                if now != (conv,):
                    now, part, at = (conv,), 0, 0
                role, text = role or "", text or ""
                formatted = render_turn(role, text)
                begin = end = None
                if role == "assistant":
                    begin = at + len(HEADER) + len(escape_role(role)) + 1
                    end = begin + len(escape(text))
                out.append((conv, part, formatted, at, begin, end))
                part, at = part + 1, at + len(formatted)
            yield _batch(out, _schema(RENDERED))

    return rows.mapInArrow(write, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """What the rendered text says: per conversation ``n_turns``, ``turns_sha256`` (role, text
    and line ends of every turn), ``loss_chars`` and ``loss_sha256`` (all text under the mask,
    unescaped), ``formatted_chars``.

    The parts pass in order; only running digests and counts are held.
    """
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, []

        def done() -> tuple:
            n, turns, chars, loss, length = state
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            out = []
            for conv, formatted, begin, loss_begin, loss_end in _values(
                batch, "conv_id", "formatted", "begin", "loss_begin", "loss_end"
            ):
                if now != (conv,):
                    if now is not None:
                        out.append(done())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if loss_begin is not None:
                    masked = unescape(formatted[loss_begin - begin : loss_end - begin])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(formatted)
            yield _batch(out, _schema(DIGESTS))
        if now is not None:
            yield _batch([done()], _schema(DIGESTS))

    return rows.mapInArrow(digest, DIGESTS)


def format_conversations(log: DataFrame) -> DataFrame:
    """Rendered messages of an event log."""
    return render(reconstruct(log))
