"""Chat formatting checked by a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` and parsed again by
a deterministic parser. Where the parsed turn differs from the source, the
conflicting content is escaped and the turn rendered again until both agree.
Inside content every ``<``, backslashes, ``|`` gets one backslash more, so no
content holds a control string and the escape undoes exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import in_arrow

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
_CONFLICT = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(content: str) -> str:
    """Content without any ``<|``; undone by ``unescape``."""
    return _CONFLICT.sub(r"<\\\1|", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<\1|", content)


def _role_in(role: str) -> str:
    return escape(role).replace("\n", LINE)


def _role_out(role: str) -> str:
    return unescape(role.replace(LINE, "\n"))


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None where it does not follow the grammar."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found or any(mark in part for mark in (START, END) for part in found.groups()):
            return None
        turns.append((_role_out(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def render(role: str, text: str) -> str:
    """One turn that parses back to exactly ``(role, text)``."""
    shown_role, shown = role, text
    while parse(rendered := f"{START}{shown_role}\n{shown}{END}\n") != [(role, text)]:
        escaped = (_role_in(role), escape(text))
        if (shown_role, shown) == escaped:
            raise ValueError("a turn does not survive the round trip")
        shown_role, shown = escaped
    return rendered


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, nth, formatted, mask_begin, mask_end)``: every turn rendered, in conversation order.

    The formatted conversation is the concatenation of its parts by ``nth``. The loss
    mask goes with it: of turns whose role is ``loss_role`` the code points ``mask_begin``
    to ``mask_end`` of the whole conversation, their text as shown; null for others. Rows
    are ordered by turn, then role, then text (nulls first), so ties and repeated
    rows have one order and stay. A null role or text is empty; a null conv_id is
    a conversation of its own. An empty table gives no rows; other columns are not
    read. One exchange by conversation; a task holds one batch, whatever the
    length of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nth, at = object(), 0, 0
        for batch in batches:
            ids, numbers, out, begins, ends = batch.column(0).to_pylist(), [], [], [], []
            for conv, role, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                nth, at = (nth + 1, at + len(out[-1] if out else last)) if conv == current else (0, 0)
                current = conv
                numbers.append(nth)
                out.append(last := render(role or "", text or ""))
                shown = _TURN.match(last).span(2) if (role or "") == loss_role else None
                begins.append(at + shown[0] if shown else None)
                ends.append(at + shown[1] if shown else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(out, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "nth", "formatted", "mask_begin", "mask_end"],
            )

    named = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").alias("text"))
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").transform(in_arrow, run, "conv_id bigint, nth bigint, formatted string, mask_begin bigint, mask_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the rendered parts of ``format_chats``.

    Expects the parts of a conversation together and in order, as that function
    leaves them; keeps running hashes only. What counts for the loss is read off the
    mask, not the roles. A conversation stays in one task, as its digests run along it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, state = None, None

        def row() -> tuple:
            return current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            for conv, nth, part, begin, end in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if nth == 0:
                    if state:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if begin is not None:
                    masked = unescape(part[begin - state[4] : end - state[4]])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "replace"))
                state[4] += len(part)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds)], names=names)

    return formatted.transform(in_arrow, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
