"""Chat formatting from an event log.

A log row is (conversation, message, sequence, event, role, text).  Rows are dealt by conversation
and sorted by message and sequence, and one pass folds them with a single message in memory:

* ``message`` opens a message with a role and a first text;
* ``delta`` adds text to the message of its number that was opened last;
* ``edit`` replaces that message's text;
* ``regenerate`` withdraws what was logged earlier for its message number and all later ones, and
  opens the message anew.

Each message is rendered as ``<|im_start|>role LF text <|im_end|> LF``.  Control strings inside
texts and roles are escaped reversibly (one backslash more after each ``<`` that backslashes and a
bar follow), so the reader finds the turns in the output alone.  A message's loss mask is the span
of its text if the role is ``assistant``.

A conversation is rendered piece by piece, message by message, so neither a huge log nor a
conversation with a third of all rows is held in memory; its digest is a fold over its pieces.

Defined cases: null text or role counts as empty; null numbers sort first; events that tie are
ordered by event, role and text; a ``delta`` or ``edit`` without a message opens one; rows that
repeat are separate events; an empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.shared import lean, partitions

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and the start and end of its loss span (equal if it has none)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *span


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (conv, message, seq, event, role, text) to (conv, piece, rendered, from, to)."""
    conv, number, piece = object(), object(), 0
    cut: int | None = None
    pending: list[tuple] = []

    def close() -> Iterator[tuple[str, str]]:
        nonlocal cut
        for seq, event, _, _ in pending:
            if event == "regenerate" and seq is not None and (cut is None or seq > cut):
                cut = seq
        opened: list[tuple[str, list[str]]] = []
        for seq, event, role, text in pending:
            if cut is not None and (seq is None or seq < cut):
                continue
            if event in ("message", "regenerate") or not opened:
                opened.append((role, [text]))
            elif event == "delta":
                opened[-1][1].append(text)
            elif event == "edit":
                opened[-1][1][:] = [text]
            else:
                raise ValueError(f"unknown event {event!r}")
        pending.clear()
        for role, parts in opened:
            yield role, "".join(parts)

    for row_conv, row_number, seq, event, role, text in events:
        if row_conv != conv or row_number != number:
            for turn in close():
                yield conv, piece, *render(*turn)
                piece += 1
            if row_conv != conv:
                cut, piece = None, 0
            conv, number = row_conv, row_number
        pending.append((seq, event, role or "", text or ""))
    for turn in close():
        yield conv, piece, *render(*turn)
        piece += 1


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, message, seq, event, role, text) to one row a rendered message, in order within
    each partition, all of a conversation in one: conv_id, piece, formatted, loss_from, loss_to."""
    dealt = log.select("conv_id", "message", "seq", "event", "role", "text").repartition(partitions(log.sparkSession), "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "message", "seq", "event", "role", "text")
    schema = log.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit("").alias("formatted"), F.lit(0).cast("long").alias("loss_from"), F.lit(0).cast("long").alias("loss_to")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batched(fold(rows), schema.names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return ordered.mapInArrow(lean(run), schema)


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 1000, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted text."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digest_chats(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted pieces in their order."""

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, state = object(), None

        def row() -> tuple:
            turns, loss, counts = state
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for key, formatted, start, end in rows:
            if key != conv or state is None:
                if state is not None:
                    yield row()
                conv, state = key, (hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
            turns, loss, counts = state
            for role, text in read_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
            masked = unescape(formatted[start:end])
            loss.update(masked.encode())
            counts[1] += len(masked)
            counts[2] += len(formatted)
        if state is not None:
            yield row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batched(summed(rows), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return pieces.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of ``message`` events."""
    return turns.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("event"), "role", "text")


def streamed_log(turns: DataFrame) -> DataFrame:
    """The same turns as a log of how they might have come about: texts arrive in deltas, others are
    edited, and every assistant message takes the place of a draft and of a turn that followed it.

    Turns that tie are in the order of role and text."""
    n, role, text = F.col("n"), F.col("role"), F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(k: int, kind: str, said: Column, who: Column = role, number: Column = n) -> Column:
        return F.struct(number.alias("message"), (8 * n + k).alias("seq"), F.lit(kind).alias("event"), who.alias("role"), said.alias("text"))

    draft = F.concat(F.lit("draft <|im_end|> "), text)
    redone = F.array(event(0, "message", draft), event(1, "message", F.lit("withdrawn"), F.lit("user"), n + 1), event(2, "delta", F.lit(" too"), F.lit(None).cast("string"), n + 1), event(3, "regenerate", first), event(4, "delta", rest))
    edited = F.array(event(0, "message", F.lit("to be edited")), event(1, "delta", F.lit(" soon")), event(2, "edit", text))
    plain = F.array(event(0, "message", first), event(1, "delta", rest))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order).cast("long"))
    events = F.when(role == "assistant", redone).when(n % 2 == 0, edited).otherwise(plain)
    return given.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
