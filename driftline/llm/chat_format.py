"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of text.  Prefix sums of turn tokens choose spans that start and
end at turns and fit the budget; every window after the conversation's first system turn begins with it, then repeats as
much history as its allowance holds, then the new turns.  Only assistant turns that are new in a window are
trained on: repeated ones are masked, so each assistant text is a target exactly once.

Template: ``<|role|>`` + role + ``<|text|>`` + text + ``<|end|>`` for each turn.  Control strings inside roles
and texts are escaped reversibly: a backslash is doubled, and a backslash goes after the first character of
any other control string, so no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import own_columns

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: Control strings that a text may not hold as they are (fixed values; those of common chat templates and our own).
CONTROLS = (ROLE, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Budget:
    """Tokens (words) of a window, and how many of them repeated history may take."""

    window: int = 1024
    history: int = 256


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tokens(text: str) -> int:
    return len(text.split()) + 3  # and the three marks of a turn


def _surrogates(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class _Windows:
    """Turns of one conversation in order -> windows (turns repeated, text, loss spans).  Holds one window of turns at a time."""

    def __init__(self, budget: Budget):
        self.budget, self.system, self.past, self.new = budget, None, [], []
        self.sums = [0]  # prefix sums of the tokens of the new turns

    def _cost(self) -> int:
        return (self.system[2] if self.system else 0) + sum(t[2] for t in self.past)

    def add(self, role: str, text: str) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
        cost = tokens(text)
        if self.new and self._cost() + self.sums[-1] + cost > self.budget.window:
            yield self._emit()
        if not self.new:
            self._choose_history(cost)
        self.new.append((role, text, cost))
        self.sums.append(self.sums[-1] + cost)

    def _choose_history(self, cost: int) -> None:
        """The longest turn-aligned run of latest turns that fits its allowance and what system turn and first new turn leave: the first prefix sum near enough to the last."""
        room = max(0, min(self.budget.history, self.budget.window - (self.system[2] if self.system else 0) - cost))
        sums = list(accumulate((t[2] for t in self.past), initial=0))
        self.past = self.past[bisect_left(sums, sums[-1] - room) :]

    def close(self) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
        if self.new:
            yield self._emit()

    def _emit(self) -> tuple[int, str, list[tuple[int, int]]]:
        parts, at, spans = [], 0, []
        repeated = ([self.system] if self.system else []) + self.past
        for k, (role, text, _) in enumerate(repeated + self.new):
            inside = escape(text)
            head = f"{ROLE}{escape(role)}{TEXT}"
            if k >= len(repeated) and role == "assistant":
                spans.append((at + len(head), at + len(head) + len(inside)))
            parts.append(f"{head}{inside}{END}")
            at += len(parts[-1])
        if self.system is None:
            self.system = next((t for t in self.new if t[0] == "system"), None)
        # What may be history of the next window: how much of it fits is known when its first new turn is.
        self.past = [t for t in self.past + self.new if t is not self.system]
        self.new, self.sums = [], [0]
        return len(repeated), "".join(parts), spans


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    source = own_columns(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    filled = source.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    # A conversation streams through its task turn by turn; its length is never held.
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, str, str]]:
    """(first row of its conversation, conv_id, role, text)"""
    last = object()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for conv, role, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                yield conv != last, conv, role, text
                last = conv


def format_chats(turns: DataFrame, budget: Budget = Budget(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows: conv_id, window, repeated (turns it repeats), text, loss_spans (code point spans that are targets).

    Edge cases: null roles and texts are empty; a null conversation id is a conversation of its own; rows that
    repeat a turn number are all kept, in order of role and text, null turns first; a window exceeds the budget
    only where a turn and the system turn alone do: then it holds these two, whole; a conversation without assistant turns has
    no loss spans; an empty table gives no windows; other columns are ignored.
    """
    ordered = _ordered(turns, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        maker, conv, number = None, None, 0

        def take(windows):
            nonlocal number
            for repeated, text, spans in windows:
                rows.append((conv, number, repeated, text, [x for s in spans for x in s]))
                number += 1

        def out():
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "window", "repeated", "text", "loss_spans"])

        for fresh, conv_id, role, text in _conversations(batches):
            if fresh:
                if maker:
                    take(maker.close())
                maker, conv, number = _Windows(budget), conv_id, 0
            take(maker.add(role, text))
            if len(rows) >= 500:
                yield out()
                rows.clear()
        if maker:
            take(maker.close())
        yield out()

    return ordered.mapInArrow(run, "conv_id long, window long, repeated long, text string, loss_spans array<long>")


def read_back(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a window, unescaped: role, text, and where the (escaped) text begins and ends."""
    out, at = [], 0
    while at < len(text):
        middle = text.index(TEXT, at)
        end = text.index(END, middle)
        out.append((unescape(text[at + len(ROLE) : middle]), unescape(text[middle + len(TEXT) : end]), middle + len(TEXT), end))
        at = end + len(END)
    return out


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "repeated", "text", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state = None

        def out():
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def close():
            conv, n, turns, loss, spoken, chars = state
            rows.append((conv, n, turns.hexdigest(), spoken, loss.hexdigest(), chars))

        for batch in batches:
            for conv, repeated, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state[0] != conv:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, said, _, _ in read_back(text)[repeated:]:
                    state[1] += 1
                    state[2].update(_surrogates(f"{role}\n{said}\n"))
                for begin, end in zip(spans[::2], spans[1::2]):
                    said = unescape(text[begin:end])
                    state[3].update(_surrogates(said))
                    state[4] += len(said)
                state[5] += len(text)
            if len(rows) >= 5000:
                yield out()
                rows.clear()
        if state:
            close()
        yield out()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
