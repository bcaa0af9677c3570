"""Chat formatting from event logs: messages are folded from what happened to them, then rendered with a loss mask.

An event log has the columns conv_id, message, seq, event, role, text. `message` names a message and gives its place in the
conversation (any type that Spark can order), `seq` orders the events of a message. Events:

- open: the message begins, with this role and text (null: empty)
- delta: the text is added at the end of what is there
- edit: the text takes the place of what is there
- regenerate: what is there goes, deltas that follow build the text anew
- remove: the message goes; a later open, edit or regenerate brings it back

An event that is there twice (same message and seq) counts once: the first by event, role and text. A message without an
open event begins with its first one; its role is the last one named. Events of other kinds and null ones do nothing. A
null conv_id is a conversation of its own.

Logs are dealt by ranges of (conv_id, message) and sorted, so a task folds a stream of events and holds one message; a
conversation of any size is spread over tasks. Each message becomes one turn:

    <|im_start|>role<|im_sep|>text<|im_end|>

Texts and roles are escaped: wherever one of CONTROL stands, with or without backslashes behind its first character, one
backslash more is put there. Reading takes it away again, so every text comes back, and no text can end a turn. Turns need
nothing between them: a conversation is its turns one after another. The loss mask covers the texts of LEARNED roles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import tuned
from tallymill.llm.runs import hex_digest, joined_runs, run_rows, run_schema

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that texts must not bring in: this template's, and those of other common ones. Each starts with < or [ and has
#: neither of them further on, so that no two can overlap.
CONTROL = [START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
LEARNED = ("assistant",)
#: Characters of a delta in logs made from whole turns.
DELTA = 400

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)({_RESTS})"), re.compile(rf"([<\[])\\(\\*)({_RESTS})")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn, and the code points of it that are under the loss mask."""
    head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
    return f"{head}{body}{END}", (len(head), len(head) + len(body)) if role in LEARNED else None


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, or of a part of one that starts and ends with a turn."""
    for found in _TURN.finditer(formatted):
        yield unescape(found[1]), unescape(found[2])


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, message, role, text) of every message that is there in the end. events: (conv_id, message, seq, event, role,
    text), message by message, in order."""
    name = seq = None
    role, text, there = "", [], False
    for conv, message, number, event, by, piece in events:
        if name is None or (conv, message) != name:
            if there:
                yield (*name, role, "".join(text))
            name, seq, role, text, there = (conv, message), None, "", [], False
        elif number == seq:
            continue
        seq = number
        if event not in ("open", "delta", "edit", "regenerate", "remove"):
            continue
        if by is not None and event != "remove":
            role = by
        if event == "remove":
            text, there = [], False
        elif event == "delta":
            text.append(piece or "")
            there = True
        else:
            text, there = [] if event == "regenerate" else [piece or ""], True
    if there:
        yield (*name, role, "".join(text))


def formatted(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, message, formatted, loss_start, loss_end (code points of `formatted`; null: no loss).

    Rows of a conversation follow one another within and over the partitions, in the order of messages. Further columns of
    events are ignored; an empty log gives an empty table.
    """
    names = ["conv_id", "message", "seq", "event", "role", "text"]
    kinds = {n: events.schema[n].dataType.simpleString() for n in names}
    order = ["conv_id", "message", "seq", "event", "role", "text"]
    # Dealt without seq: all events of a message meet.
    rows = tuned(events.sparkSession) and events.select(*names).repartitionByRange("conv_id", "message").sortWithinPartitions(*order)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def values() -> Iterator[tuple]:
            for batch in batches:
                types[:] = batch.schema.types
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held, size = [], 0

        def flush() -> pa.RecordBatch:
            kind = [types[0], types[1], pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*held), kind)], names=["conv_id", "message", "formatted", "loss_start", "loss_end"])

        for conv, message, role, text in fold(values()):
            line, loss = render(role, text)
            held.append((conv, message, line, *(loss or (None, None))))
            size += len(line) + 100
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(turns, f"conv_id {kinds['conv_id']}, message {kinds['message']}, formatted string, loss_start bigint, loss_end bigint")


def read_back(turns: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row per conversation of `formatted`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All is read from the formatted texts: turns_sha256 is over role, newline, text, newline of each turn, the loss columns
    over the texts under the mask, unescaped.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items(first: pa.RecordBatch) -> Iterator[tuple]:
            for batch in (b for some in ([first], batches) for b in some):
                for conv, line, start, end in zip(*(batch[n].to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
                    whole = "".join(f"{role}\n{text}\n" for role, text in read_turns(line)).encode()
                    loss = unescape(line[start:end]) if start is not None else ""
                    yield conv, (1, len(loss), len(line)), (whole, loss.encode())

        if (first := next(batches, None)) is not None:
            yield from run_rows(items(first), first.schema.field("conv_id").type, chunk=chunk)

    kind = turns.schema["conv_id"].dataType.simpleString()
    done = joined_runs(turns.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(read, run_schema(kind)))
    return done.select(
        F.col("key").alias("conv_id"), F.col("counts")[0].alias("n_turns"), hex_digest("parts", 0).alias("turns_sha256"),
        F.col("counts")[1].alias("loss_chars"), hex_digest("parts", 1).alias("loss_sha256"), F.col("counts")[2].alias("formatted_chars"))


def event_log(conversations: DataFrame) -> DataFrame:
    """The log of a table of whole turns (conv_id, turn, role, text): learned turns come as deltas, others at once.

    Null turns come first; turns of one number are ordered by a hash of role and text, and equal rows are turns each. Null
    roles and texts are empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        "conv_id", F.struct("turn", F.xxhash64(role, text).alias("tie"), F.monotonically_increasing_id().alias("row")).alias("message"),
        role.alias("role"), text.alias("text"))
    pieces = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)),
        lambda piece, k: F.struct((k + 1).cast("bigint").alias("seq"), F.lit("delta").alias("event"), F.lit(None).cast("string").alias("role"), piece.alias("text")))
    opened = lambda beginning: F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("open").alias("event"), F.col("role"), beginning.alias("text"))
    events = F.when(F.col("role").isin(*LEARNED), F.concat(F.array(opened(F.lit(""))), pieces)).otherwise(F.array(opened(F.col("text"))))
    return rows.select("conv_id", "message", F.inline(events))
