"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns of its conversation are the context, and only that
reply is trainable. The template marks each turn

    <|role|>ROLE<|text|>TEXT<|end|>

and every control string that occurs inside a role or text (those of this template and of common public templates) is
escaped by a backslash after its first character, as is the backslash itself by another one, so that a text can neither
close a turn nor open one, and reading back gives the text exactly. The loss mask of an example is one span of code points.

Conversations are dealt by id, sorted by turn inside partitions, and folded as a stream: a task holds the running context
of one conversation and an output batch of bounded size. An example repeats its context, which is what the method asks
for: the output's text grows with the square of the turns of one conversation, the number of rows only with the turns.

Defined results: null roles and texts are empty; null turns come first, equal turns are ordered by role and text; repeated
rows are turns of their own; rows with a null conversation id form one conversation; turns after the last assistant turn
are kept in a closing example without loss, so every turn can be read back; empty tables give no examples; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: The control strings that are escaped inside roles and texts.
CONTROL = (ROLE, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_NEEDS = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(ROLE) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
OUT_BYTES = 8 << 20
EXAMPLE = "conv_id {kind}, example_no long, turns long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where the escaped text lies in it."""
    head = ROLE + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def expand_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Examples of (conv_id, turn, role, text) rows: conv_id, example_no (from 0), turns (in the example), text, loss_start and
    loss_end (code points; both null in the closing example of a conversation that does not end with the target role).

    A conversation's examples lie in one partition, one after another.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    schema = EXAMPLE.format(kind=rows.schema["conv_id"].dataType.simpleString())
    nothing = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, context, chars, count, number, closed, kind = nothing, [], 0, 0, 0, True, None
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            a, b, c, d, e, f = zip(*out)
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(a, kind), *(pa.array(x, pa.int64()) for x in (b, c)), pa.array(d, pa.string()), *(pa.array(x, pa.int64()) for x in (e, f))], ["conv_id", "example_no", "turns", "text", "loss_start", "loss_end"])

        def add(start: int | None, stop: int | None) -> None:
            nonlocal number, held, context
            whole = "".join(context)
            context = [whole]
            out.append((now, number, count, whole, start, stop))
            number += 1
            held += len(whole)

        for batch in text_batches(batches):
            kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is nothing or conv != now:
                    if not closed:
                        add(None, None)
                    now, context, chars, count, number = conv, [], 0, 0, 0
                piece, start, stop = format_turn(role, text)
                context.append(piece)
                count += 1
                closed = role == target
                if closed:
                    add(chars + start, chars + stop)
                chars += len(piece)
                if held > OUT_BYTES:
                    yield flush()
        if not closed:
            add(None, None)
        if out:
            yield flush()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, schema)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from their texts: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars (of the example with all turns), n_examples. Takes examples as expand_conversations leaves
    them: a conversation's rows in one partition, in order."""
    nothing = object()
    schema = f"conv_id {examples.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss, chars, count, kind = nothing, "", hashlib.sha256(), 0, 0, None
        done: list[tuple] = []

        def close() -> None:
            turns = read_turns(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            done.append((now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(last), count))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])

        for batch in text_batches(batches):
            kind = batch.column("conv_id").type
            for conv, text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
                if now is nothing or conv != now:
                    if now is not nothing:
                        close()
                    now, loss, chars, count = conv, hashlib.sha256(), 0, 0
                last = text
                count += 1
                if start is not None:
                    reply = unescape(text[start:stop])
                    loss.update(reply.encode())
                    chars += len(reply)
            if len(done) > 5_000:
                yield flush()
        if now is not nothing:
            close()
        if done:
            yield flush()

    return examples.mapInArrow(run, schema)
