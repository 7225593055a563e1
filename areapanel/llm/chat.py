r"""Chat formatting in budgeted windows of whole turns.

A conversation's turns, in order, get token counts; prefix sums of them choose windows: each takes as many whole new
turns as the budget allows after the system turn, which every window keeps, and a limited number of turns
repeated from before as history. A turn longer than the budget is a window of its own and stays whole.

Template, one block per turn: `<turn N role>`, newline, text, newline, `</turn>`, newline. In roles and texts the
backslash, `<` and `>` are escaped by a backslash, so that nothing inside a text looks like a mark;
taking one backslash off each pair gives the text back. Loss spans (code points of the window's text) cover the escaped
text of assistant turns, each in the window where it is new; repeated turns are masked out.

Turns are ordered by turn, role, text (null turns first); null texts and roles are empty. A conversation is streamed
in order through one task, which holds one window and the history, never the whole conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import query, stage, table

BUDGET = 256
HISTORY_TURNS = 2
HISTORY_TOKENS = 64
TURN_TOKENS = 4
OWN_ROWS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
WINDOWS = ("conv_id long, window long, first_turn long, n_turns int, n_repeated int, n_tokens long, text string, "
           "loss_from array<int>, loss_to array<int>")

_MARKS = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn (\d+) ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)\n</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Windows:
    """Windows of one conversation after the other, from turns in order."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.rows: list[tuple] = []
        self.conv: object = self

    def _start(self, conv):
        self.conv, self.number, self.window = conv, 0, 0
        self.system, self.new, self.past = None, [], []
        self.total = self.begun = 0  # prefix sums: of all turns so far, of those before this window

    def add(self, conv, role: str, text: str):
        if conv != self.conv:
            self.close()
            self._start(conv)
        turn = (self.number, role, text, len(text.split()) + TURN_TOKENS)
        if self.number == 0 and role == "system":
            self.system = turn
        fixed = (self.system[3] if self.system and self.new and self.new[0] is not self.system else 0) + sum(t[3] for t in self.past)
        if self.new and self.total + turn[3] - self.begun + fixed > self.budget:
            self._emit()
            self.past = self._history(turn)
            self.begun = self.total
        self.new.append(turn)
        self.total += turn[3]
        self.number += 1

    def _history(self, coming):
        """The last turns before the coming one that the history limits and the budget leave room for."""
        room = min(self.history_tokens, self.budget - coming[3] - (self.system[3] if self.system else 0))
        out = []
        for turn in reversed([*self.past, *self.new]):
            if turn is self.system or len(out) == self.history_turns or turn[3] > room:
                break
            room -= turn[3]
            out.insert(0, turn)
        return out

    def _emit(self):
        kept = [self.system] if self.system and self.new[0] is not self.system else []
        repeated = [*kept, *self.past]
        parts, at, spans = [], 0, []
        for i, (number, role, text, _) in enumerate([*repeated, *self.new]):
            head, body, tail = f"<turn {number} {escape(role)}>\n", escape(text), "\n</turn>\n"
            if i >= len(repeated) and role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body) + len(tail)
            parts += [head, body, tail]
        self.rows.append((self.conv, self.window, self.new[0][0], len(repeated) + len(self.new), len(repeated),
                          sum(t[3] for t in [*repeated, *self.new]), "".join(parts), [s[0] for s in spans], [s[1] for s in spans]))
        self.window += 1
        self.past = [*self.past, *self.new][-max(self.history_turns, 1):]
        self.new = []

    def close(self):
        if self.conv is not self and self.new:
            self._emit()

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_WINDOW_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int32()),
                            ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()),
                            ("loss_from", pa.list_(pa.int32())), ("loss_to", pa.list_(pa.int32()))])


def _format(budget, history_turns, history_tokens):
    def run(batches):
        windows = Windows(budget, history_turns, history_tokens)
        for batch in batches:
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                windows.add(conv, role or "", text or "")
                if len(windows.rows) >= 500:
                    yield _batch(windows.taken(), _WINDOW_SCHEMA)
        windows.close()
        if windows.rows:
            yield _batch(windows.taken(), _WINDOW_SCHEMA)
    return run


def format_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Formatted windows of turns (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(budget, history_turns, history_tokens), WINDOWS)


def parse(text: str) -> list[tuple[int, str, str]]:
    """(number, role, text) of each turn of a window; raises if anything else is in it."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((int(m.group(1)), unescape(m.group(2)), unescape(m.group(3))))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_READ_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                          ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _read_back(batches):
    conv, state, rows = _read_back, None, []

    def done():
        turns, loss = state["turns"], state["loss"]
        rows.append((conv, state["n"], turns.hexdigest(), state["chars"], loss.hexdigest(), state["length"], state["windows"]))
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss_from", "loss_to")]
        for own, repeated, text, starts, stops in zip(*columns):
            if own != conv:
                if state:
                    done()
                conv, state = own, {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "length": 0, "windows": 0}
            for _, role, said in parse(text)[repeated:]:
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["n"] += 1
            for a, b in zip(starts, stops):
                said = unescape(text[a:b])
                state["loss"].update(said.encode())
                state["chars"] += len(said)
            state["length"] += len(text)
            state["windows"] += 1
        if len(rows) >= 500:
            yield _batch(rows, _READ_SCHEMA)
            rows = []
    if state:
        done()
    if rows:
        yield _batch(rows, _READ_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its formatted windows alone: the turns, the text under the loss mask, the sizes."""
    ordered = windows.select("conv_id", "window", "n_repeated", "text", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions(
        "conv_id", "window")
    return ordered.mapInArrow(_read_back, READ)


@query("op9_chat_windows")
def op9(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN_ROWS, "conv_id long, turn long, role string, text string")
    return read_back(stage(format_windows(turns.unionByName(own)), "windows"))
