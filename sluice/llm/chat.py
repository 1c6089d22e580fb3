"""Chat formatting with a grammar round trip.

    conversation = { turn }
    turn = "[INST] " text " [/INST]"             user
         | "<s>" text "</s>"                     assistant
         | "[SYS] " text " [/SYS]"               system
         | "[TURN " name "] " text " [/TURN]"    any other role, its name percent-encoded

A text ends at the first closing mark. In a text, a backslash after the first character of a control string takes its
meaning away, and one such backslash is taken off when the text is read. Each stretch of turns is rendered as it is,
read back with the grammar and compared; the texts that do not come back as they were are escaped, until all do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns that are rendered and checked together; a longer conversation comes in several parts.
STRETCH = 256
_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
_CONTROL = r"(/?(?:s>|INST\]|SYS\]|TURN))"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\] (?P<system>.*?) \[/SYS\]"
    r"|\[TURN (?P<name>[^\]]*)\] (?P<other>.*?) \[/TURN\]", re.S,
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and where assistants' texts stand in it."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        before, after = _MARKS.get(role) or (f"[TURN {quote(role, safe='')}] ", " [/TURN]")
        if role == "assistant":
            loss.append((at + len(before), at + len(before) + len(text)))
        parts += [before, text, after]
        at += len(before) + len(text) + len(after)
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None if it is not of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            return None
        role = found.lastgroup
        turns.append((unquote(found["name"]) if role == "other" else role, unescape(found[role])))
        at = found.end()
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and loss spans, proved by reading it back."""
    texts = [text for _, text in turns]
    for attempt in range(3):
        formatted, loss = _render([(role, text) for (role, _), text in zip(turns, texts)])
        if parse(formatted) == turns:
            return formatted, loss
        for k, turn in enumerate(turns):
            if attempt or parse(_render([turn])[0]) != [turn]:
                texts[k] = escape(turn[1])
    raise ValueError("The turns do not come back from their rendering.")


def format_conversations(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss`` (spans of the assistants' texts, end exclusive), by conversation and part.

    Rows ``conv_id, turn, role, text``: null text and null role are empty, null turns come first, equal turns go by role
    and text, and repeated rows are turns of their own. Null ids are one conversation. A conversation of more than
    ``stretch`` turns comes in several parts, so a task holds no more than that. Other columns are not read; an empty
    table gives an empty table. Rows of a conversation stand together, parts in order.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, part, turns):
            formatted, loss = render(turns)
            spans = [{"start": a, "end": b} for a, b in loss]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([len(turns)], pa.int64()), pa.array([formatted], pa.string()), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "part", "n_turns", "formatted", "loss"],
            )

        def joined(made):
            return pa.Table.from_batches(made).combine_chunks().to_batches()

        conv, part, turns, made, size = None, 0, [], [], 0
        for batch in batches:
            for at, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if turns and (at != conv or len(turns) == stretch):
                    made.append(row(conv, part, turns))
                    size += made[-1].nbytes
                    part, turns = (part + 1 if at == conv else 0), []
                    if size > 1 << 22:
                        yield from joined(made)
                        made, size = [], 0
                conv = at
                turns.append((role, text))
        if turns:
            made.append(row(conv, part, turns))
        if made:
            yield from joined(made)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, part int, n_turns long, formatted string, loss array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from formatted parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)

        def close():
            if state is not None:
                conv, turns, told, chars, loss, size = state
                done.append((conv, turns, told.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == 0:
                    close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if len(done) > 5000:
                yield out()
                done = []
        close()
        yield out()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
