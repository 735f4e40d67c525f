"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles whose text is learnt, and which role may follow which (None: the start)."""
    open: str = "<|im_start|>"
    head: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {
        None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})


TEMPLATE = Template()
END_IN_ROLE = "<|end of role|>"  # no escaped text holds it
SEGMENTS = ("conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean")


def escape(text: str) -> str:
    """A backslash more between ``<`` and ``|``, so that no control string stands in a text."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def role_text(role: str, template: Template) -> str:
    """A role as it stands in its mark: escaped, and with the string that ends a mark written as a control string."""
    return escape(role).replace(template.head, END_IN_ROLE)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number, valid, begun = None, None, 0, True, False
        for batch in batches:
            out = [[] for _ in range(6)]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not begun or conv != now:
                    now, state, number, valid, begun = conv, None, 0, True, True
                role, text = role or "", text or ""
                valid = valid and role in template.follows.get(state, ())
                state = role
                parts = ((template.open + role_text(role, template) + template.head, False),
                         (escape(text), role in template.loss_roles), (template.close, False))
                for i, (part, loss) in enumerate(parts):
                    for column, value in zip(out, (conv, number, i, part, loss, valid)):
                        column.append(value)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))],
                names=["conv_id", "turn_no", "segment", "text", "loss", "valid"])
    return run


def segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Text segments in order, three a turn (mark with role, text, end mark), with their loss flag; ``valid`` is
    false from the first turn on that may not follow the one before it. Rows of a conversation lie in one
    partition, sorted by turn (nulls first, ties by role and text), and are streamed: no conversation is held
    in memory. Null role or text is empty; a null conv_id is one conversation; other columns are not read."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_format(template), SEGMENTS))


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        now, begun, turns, masked, counts, good = None, False, None, None, None, True
        pending, learnt = "", []  # text after the last whole turn, and what of it is under the loss mask
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return batch

        def finish() -> None:
            if pending:
                raise ValueError(f"conversation {now} ends inside a turn")
            done.append((now, counts[0], turns.hexdigest(), counts[1], masked.hexdigest(), counts[2], good))

        for batch in batches:
            for conv, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if not begun or conv != now:
                    if begun:
                        finish()
                    now, begun, turns, masked, counts, good = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], True
                counts[2] += len(text)
                if loss:
                    learnt.append(text)
                look = max(0, len(pending) - len(template.close))
                pending += text
                while (end := pending.find(template.close, look)) >= 0:
                    if not pending.startswith(template.open):
                        raise ValueError(f"conversation {conv} has text outside its turns")
                    mark = pending.index(template.head, len(template.open), end)
                    role, plain = pending[len(template.open):mark], pending[mark + len(template.head):end]
                    counts[0] += 1
                    turns.update(f"{unescape(role.replace(END_IN_ROLE, template.head))}\n{unescape(plain)}\n".encode())
                    plain = unescape("".join(learnt))
                    counts[1] += len(plain)
                    masked.update(plain.encode())
                    pending, learnt, look = pending[end + len(template.close):], [], 0
                good = good and valid
            yield flush()
        if begun:
            finish()
            yield flush()
    return run


def read_back(parts: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, from the formatted text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid. Turns are found by the template's marks in the text that the segments make one after
    another, so a text that could pass for a mark would be seen here; a turn may be cut into segments anywhere. Loss
    flags give the learnt text. Text outside turns or an unfinished turn is an error. Takes segments as ``segments``
    leaves them; ``sorted_segments`` brings stored ones back into that order. A null conv_id is one conversation; a
    conversation is read by one task (its digest is a chain), a turn at a time; an empty table gives no rows."""
    return parts.select("conv_id", "turn_no", "segment", "text", "loss", "valid").mapInArrow(
        _read(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                         "formatted_chars long, valid boolean")


def sorted_segments(parts: DataFrame) -> DataFrame:
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment")
