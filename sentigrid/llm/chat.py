"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import SLICE, _arrow_schema, record_batch, text_of

# (role, opening, closing); any other role is named in its mark.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE:", ">>", "<</ROLE>>")
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE")
_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b", ">": "\\g"}
_IN = {"\\": "\\", "l": "<", "b": "[", "g": ">"}
_ESCAPED = re.compile(r"\\([\\lbg])")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
                   r"|<<ROLE:(?P<role>.*?)>>(?P<other>.*?)<</ROLE>>", re.DOTALL)
# Rows that leave a task at once; texts of long conversations are long.
_BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _CONTROL.sub(lambda m: _OUT[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _IN[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its escaped text starts and ends."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        named = re.sub(r"[\\<>\[]", lambda m: _OUT[m[0]], role)
        opening, closing = OTHER[0] + named + OTHER[1], OTHER[2]
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a formatted example."""
    for m in _TURN.finditer(formatted):
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"])
        else:
            yield m.lastgroup, unescape(m[m.lastgroup])


EXAMPLE = ("conv bigint, example bigint, is_last boolean, formatted string, loss_start bigint, loss_end bigint, "
           "n_turns bigint")


def _expand(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Examples of the conversations in (conv, role, text) rows sorted by conversation and turn."""
    current, prefix, number, turns, held, open_ = object(), [], 0, 0, None, False

    def rest():
        # the last example carries the turns behind the last reply too, none of them trainable
        if held is not None and not open_:
            yield (*held[:2], True, *held[3:])
        elif open_:
            if held is not None:
                yield held
            at = sum(map(len, prefix))
            yield current, number, True, "".join(prefix), at, at, turns

    for conv, role, text in rows:
        if conv != current:
            yield from rest()
            current, prefix, number, turns, held, open_ = conv, [], 0, 0, None, False
        shown, start, end = render(role, text)
        before = sum(map(len, prefix))
        prefix = ["".join(prefix), shown]
        turns += 1
        open_ = True
        if role == "assistant":
            if held is not None:
                yield held
            held = (conv, number, False, "".join(prefix), before + start, before + end, turns)
            number, open_ = number + 1, False
    yield from rest()


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One training example per assistant turn: all turns up to it as text, only that reply trainable.

    (conv, example, is_last, formatted, loss_start, loss_end, n_turns); the loss span holds
    the reply's escaped text. Turns behind the last reply form one more example without a trainable part, so
    the examples hold every turn. Conversations are sorted within partitions and streamed: a task holds one
    conversation's text and never a whole group of rows.

    A null text or role is empty; a null conversation id is a conversation of its own; repeated turn numbers are
    ordered by role, then text, null turn numbers first; repeated rows are turns like others. An empty table
    has no examples. Other columns are ignored.
    """
    picked = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                          text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    placed = picked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    schema = _arrow_schema(turns.sparkSession.createDataFrame([], EXAMPLE).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))

        held, size = [], 0
        for example in _expand(rows()):
            held.append(example)
            size += len(example[3])
            if size > _BATCH_CHARS:
                yield record_batch(held, schema)
                held, size = [], 0
        if held:
            yield record_batch(held, schema)

    return placed.mapInArrow(run, EXAMPLE)


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint, n_examples bigint")


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the formatted examples say, one row per conversation.

    Turns are parsed from a conversation's last example, trainable texts from every example's loss span. The examples of a
    conversation leave one task one after another, so they are read in place, without a shuffle.
    """
    schema = _arrow_schema(examples.sparkSession.createDataFrame([], DIGEST).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        loss, loss_chars, chars, n = sha256(), 0, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, last, text, start, end, _ = (c[i].as_py() for c in batch.columns)
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                loss_chars, chars, n = loss_chars + len(reply), chars + len(text), n + 1
                if last:
                    told, count = sha256(), 0
                    for role, said in parse(text):
                        told.update(f"{role}\n{said}\n".encode())
                        count += 1
                    out.append((conv, count, told.hexdigest(), loss_chars, loss.hexdigest(), chars, n))
                    loss, loss_chars, chars, n = sha256(), 0, 0, 0
            if out:
                yield record_batch(out, schema)
                out = []

    return examples.mapInArrow(run, DIGEST)


def control_case(spark, conv: Column | int = -1) -> DataFrame:
    """A conversation whose texts look like the template."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)],
                                 "conv_id bigint, turn bigint, role string, text string")
