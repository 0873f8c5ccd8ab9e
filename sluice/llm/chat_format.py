"""Chat formatting: conversations as training windows under a token budget.

A conversation's turns are laid out in windows: prefix sums of turn tokens, ids of a tokenizer, choose the longest run of
new turns that fits beside the system turn (the first turn, if its role is system), which every window
retains, and a limited history of the turns before.  Only what assistants say for the first time is
under the loss mask; repeated turns are masked.

The template writes ``<|turn|>role<|text|>text<|end|>`` for each turn.  Control strings inside roles and
texts, the template's own and those of other well-known templates, get a backslash after their first
character, and every backslash is doubled, so no control string is left and reading undoes it exactly.

Turns are sorted and streamed: a task holds the system turn, the history and one window, however long a conversation is.

Defined cases: null text or role is empty; turns are ordered by turn (nulls first), then role, then text, and
repeated rows are turns of their own; rows with a null id form one conversation; a turn larger than
the budget has a window of its own and is never cut; no rows give no conversations; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import prepare
from ._tokens import word_encoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings that a text may not hold unescaped.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"(?:{re.escape(c)})" for c in sorted(CONTROL, key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(\\?)")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
WINDOW = "conv_id long, window long, text string, n_context int, n_tokens long, loss array<struct<start: int, end: int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), _LOSS]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


class Windows:
    """One conversation's turns to windows: ``feed`` a turn, then ``finish``; both give windows that are complete.

    ``count`` gives the tokens of a formatted turn, ``budget`` those of a window, ``history`` those of its repeated turns but the system's.
    """

    def __init__(self, budget: int, history: int, count: Callable[[str], int]):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.context: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.size = self.turns = 0

    def feed(self, role: str, text: str, size: int | None = None) -> list[dict]:
        """``size``: the turn's tokens, where they have been counted."""
        turn = (role, text, self.count(formatted(role, text)) if size is None else size)
        out = []
        if self.new and self.size + turn[2] > self.budget:
            out = self.finish()
        if not self.new:
            self._begin(turn)
        self.new.append(turn)
        self.size += turn[2]
        if not self.turns and role == "system":
            self.system = turn
        self.turns += 1
        return out

    def _begin(self, turn: tuple[str, str, int]) -> None:
        """Choose the context of the window that begins with a turn: a suffix of the past by its sums from the end."""
        kept = [self.system] if self.system and self.turns else []
        sums = list(accumulate((c for _, _, c in reversed(self.past)), initial=sum(c for _, _, c in kept)))
        take = sum(1 for x in sums[1:] if x - sums[0] <= self.history and x + turn[2] <= self.budget)
        self.context = kept + (self.past[len(self.past) - take :] if take else [])
        self.size = sums[take]

    def finish(self) -> list[dict]:
        if not self.new:
            return []
        parts, loss, length = [], [], 0
        for k, (role, text, _) in enumerate((*self.context, *self.new)):
            head, said = f"{TURN}{escape(role)}{TEXT}", escape(text)
            if k >= len(self.context) and role == "assistant":
                loss.append({"start": length + len(head), "end": length + len(head) + len(said)})
            parts += [head, said, END]
            length += len(head) + len(said) + len(END)
        out = {"text": "".join(parts), "n_context": len(self.context), "n_tokens": self.size, "loss": loss}
        recent = self.past + [t for t in self.new if t is not self.system]
        first, held = len(recent), 0
        while first and held + recent[first - 1][2] <= self.history:
            first -= 1
            held += recent[first][2]
        self.past, self.new, self.context = recent[first:], [], []
        return [out]


def windows(turns: list[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> list[dict]:
    """All windows of a conversation given as role and text."""
    made = Windows(budget, history, count)
    return [w for role, text in turns for w in made.feed(role, text)] + made.finish()


def read_window(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _READ.finditer(text)]


def format_conversations(turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``WINDOW``: a row for each window, those of a conversation one after the other in a partition; a window's tokens are counted by ``tokenizer``."""
    prepare(turns.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)

        def counted(texts: list[str]) -> list[int]:
            return [len(ids) // 4 for ids in encoder.encode([t.encode("utf-8", "surrogatepass") for t in texts])]

        count = lambda text: counted([text])[0]
        made, current, number, out, size = None, None, 0, [], 0

        def put(found: list[dict]) -> None:
            nonlocal number, size
            for w in found:
                out.append((current, number, w["text"], w["n_context"], w["n_tokens"], w["loss"]))
                number += 1
                size += len(w["text"])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=[f.split()[0] for f in WINDOW.split(", ", 5)])

        for rows in batches:
            convs, roles, texts = (c.to_pylist() for c in rows.columns)
            sizes = counted([formatted(role, text) for role, text in zip(roles, texts, strict=True)])
            for conv, role, text, tokens in zip(convs, roles, texts, sizes, strict=True):
                if made is None or conv != current:
                    if made is not None:
                        put(made.finish())
                    made, current, number = Windows(budget, history, count), conv, 0
                put(made.feed(role, text, tokens))
                if size > 1_000_000:
                    yield batch()
                    out, size = [], 0
        if made is not None:
            put(made.finish())
        if out:
            yield batch()

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(work, WINDOW)
