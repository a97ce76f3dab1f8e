"""Chat formatting by prefix-target expansion.

Every assistant turn becomes a training example of its own: all turns before it as context, and only its
text under the loss mask. Turns that no reply follows form a last example without a target, so the output
holds every turn. Control strings inside texts are escaped by a backslash after their bracket, and one is
taken off again when the output is read back.

The turns of a conversation are dealt by conversation and sorted by (turn, role, text); a task streams
over them and holds one conversation's formatted text.

Defined results: null text or role is empty; rows that share a turn number all count, in the order above;
a null turn number sorts first; a null conversation id is a conversation of its own; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = "conv_id bigint, example int, formatted string, loss_start bigint, loss_end bigint"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
#: Examples that leave a task at once are at most so many characters, or one example.
BATCH_CHARS = 1 << 22

_CONTROL = re.compile(r"([\[<])(\\*)(?=/?(?:INST\]|SYS\]|TURN[ \]]|s>))")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(?=/?(?:INST\]|SYS\]|TURN[ \]]|s>))")
_OTHER = re.compile(r"\[TURN (.*?)\] ", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends in it."""
    text = escape(text)
    if role == "assistant":
        return f"{text}</s>", 0, len(text)
    if role in ("user", "system"):
        mark = {"user": "INST", "system": "SYS"}[role]
        head, tail = f"[{mark}] ", f" [/{mark}]"
    else:
        name = json.dumps(role)
        for c in "[]<":
            name = name.replace(c, f"\\u{ord(c):04x}")
        head, tail = f"[TURN {name}] ", " [/TURN]"
    return head + text + tail, len(head), len(head) + len(text)


def read_turns(formatted: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """The turns of formatted text from place ``at``, which begins a turn."""
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, head, tail = "user", 7, " [/INST]"
        elif formatted.startswith("[SYS] ", at):
            role, head, tail = "system", 6, " [/SYS]"
        elif m := _OTHER.match(formatted, at):
            role, head, tail = json.loads(m[1]), m.end() - at, " [/TURN]"
        else:
            role, head, tail = "assistant", 0, "</s>"
        end = formatted.index(tail, at + head)
        yield role, unescape(formatted[at + head : end])
        at = end + len(tail)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held, now, text, n, open_turns = 0, object(), "", 0, False

    def flush():
        nonlocal held
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "example", "formatted", "loss_start", "loss_end"])
        out.clear()
        held = 0
        return batch

    for conv, _, role, body in _rows(batches):
        if conv != now:
            if open_turns:
                out.append((now, n, text, len(text), len(text)))
                held += len(text)
            now, text, n, open_turns = conv, "", 0, False
        turn, start, end = format_turn(role or "", body or "")
        if role == "assistant":
            out.append((conv, n, text + turn, len(text) + start, len(text) + end))
            held += len(text) + len(turn)
            n += 1
        text, open_turns = text + turn, role != "assistant"
        if held >= BATCH_CHARS:
            yield flush()
    if open_turns:
        out.append((now, n, text, len(text), len(text)))
    yield flush()


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def expand_targets(conversations: DataFrame) -> DataFrame:
    """The training examples: conv_id, example, formatted, loss_start, loss_end (characters).

    The examples of a conversation follow each other in one partition.
    """
    return _sorted_turns(conversations).mapInArrow(_expand, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, state = object(), None

    def close():
        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for conv, _, formatted, start, end in _rows(batches):
        if conv != now or state is None:
            if state:
                close()
            now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
        if not formatted.startswith(state[5]):
            raise ValueError(f"the examples of conversation {conv} are not prefixes of each other")
        for role, text in read_turns(formatted, len(state[5])):
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
        target = unescape(formatted[start:end])
        state[2] += len(target)
        state[3].update(target.encode())
        state[4] += len(formatted)
        state[5] = formatted
    if state:
        close()
    columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from ``expand_targets``'s rows.

    formatted_chars counts the characters of all examples of the conversation.
    """
    return examples.mapInArrow(_digest, DIGEST)
