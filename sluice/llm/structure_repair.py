"""Repair of a conversation's structure by its cheapest edits.

A conversation's rows, in order, must give roles with initials ``(s?(ua)+)?``: perhaps a system turn, then user and assistant
in turn.  Keep costs nothing, Rerole to user or assistant 2, Delete 3 (the only edit of a blank or repeated row), Insert of
an empty user or assistant turn 2; a truncated row that stays adds 1.  The edits are a path through the implicit lattice of
(row, grammar state), found by Dijkstra's algorithm with the key (cost, audit), where the audit spells the edits' initials;
the first accepting end node that is popped is the answer, so ties go to the least audit.

Two audits of one cost at one node never begin one another (both read the same rows, and a further Insert costs), so
their order doesn't change as they grow, and the key serves as a distance.

Rows are streamed.  A long conversation is solved a block of rows at a time: the best path to each of the four grammar
states is carried on, unless another one costs less even if it then goes on likewise, and what all of these have in common is decided and given out, so that a task holds a block and
what is undecided, and of the rest the audit alone.

Defined cases: null role or text is one space; rows are ordered by turn (nulls first), role, text, and repeated rows are rows of
their own (the later ones repeated); a role with another initial, or none, can't be kept; rows with a null id form one
conversation; no rows give no conversations; other columns aren't read.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import prepare

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: What a kept row leads to, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What an inserted or changed turn leads to, by state.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs at most to go on from one state (row) as from another (column): by an inserted turn or two, or by deleting a system turn.
INSTEAD = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that are solved at once, and rows up to which a solution is kept for the next conversation of the same shape.
BLOCK, SHORT = 1024, 32
WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = range(4)

REPORT = "struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"
SCHEMA = f"conv_id long, edit string, role string, text string, report {REPORT}"
_REPORT = pa.struct([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), _REPORT]


def shape(role: str, fault: int) -> str:
    """A row as the lattice sees it: ``-`` if it must go, else its initial (``x`` for others), in capitals if truncated."""
    if fault in (BLANK, DUPLICATE):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == CUT else initial


def cheapest(rows: str, labels: tuple[tuple[int, int], ...], final: bool) -> list[tuple[int, int, int, str]]:
    """Dijkstra over the lattice of ``rows`` from ``labels``, (state, cost) in the order of their audits so far.

    Gives state, label and cost of an end node, and the edits: of the first accepting one, or, if more rows follow, of each state that is
    reached by an edit of the last row (what is inserted after it is the next rows' business).
    """
    heap = [(cost, rank, "", 0, state) for rank, (state, cost) in enumerate(labels)]
    heap.sort()
    settled = set()
    ends = []
    while heap:
        cost, rank, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(rows):
            if not final:
                ends.append((state, rank, cost, audit))
                continue
            if state in ACCEPTING:
                return [(state, rank, cost, audit)]
        else:
            row = rows[i]
            heappush(heap, (cost + DELETE, rank, audit + "D", i + 1, state))
            if row != "-":
                stays = cost + (TRUNCATED if row.isupper() else 0)
                kept = KEPT.get((state, row.lower()))
                if kept is not None:
                    heappush(heap, (stays, rank, audit + "K", i + 1, kept))
                heappush(heap, (stays + REROLE, rank, audit + "R", i + 1, TURN[state]))
        heappush(heap, (cost + INSERT, rank, audit + "I", i, TURN[state]))
    return ends


_remembered = lru_cache(20_000)(cheapest)


class Repair:
    """One conversation: ``feed`` its rows in order, then ``finish``; both give the edits that are decided, as (edit, role, text)."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.labels: list[tuple[int, int, str]] = [(START, 0, "")]  # state, cost, edits since what is decided
        self.held: list[tuple[str, str]] = []  # rows since what is decided
        self.next = 0  # the first held row that isn't decided
        self.pending: list[str] = []
        self.state = START  # after what is decided
        self.audit: list[str] = []
        self.cost = 0

    def feed(self, role: str, text: str, fault: int) -> list[tuple[str, str, str]]:
        must_go = fault in (BLANK, DUPLICATE)
        self.held.append((role, "" if must_go else text))
        self.pending.append(shape(role, fault))
        return self._advance(False) if len(self.pending) == self.block else []

    def finish(self) -> list[tuple[str, str, str]]:
        return self._advance(True)

    def _advance(self, final: bool) -> list[tuple[str, str, str]]:
        labels = sorted(self.labels, key=lambda x: x[2])
        solve = _remembered if len(self.pending) <= SHORT else cheapest
        found = solve("".join(self.pending), tuple((s, c) for s, c, _ in labels), final)
        self.pending = []
        worse = {s for s, _, cost, _ in found for t, _, other, _ in found if other + INSTEAD[t][s] < cost}
        self.labels = [(state, cost, labels[rank][2] + audit) for state, rank, cost, audit in found if state not in worse]
        common = os.path.commonprefix([x[2] for x in self.labels])
        self.labels = [(state, cost, edits[len(common) :]) for state, cost, edits in self.labels]
        self.audit.append(common)
        self.cost = self.labels[0][1]
        return self._decide(common)

    def _decide(self, edits: str) -> list[tuple[str, str, str]]:
        out, k = [], 0
        for edit in edits:
            role, text = "", ""
            if edit != "I":
                role, text = self.held[k]
                k += 1
            if edit in "RI":
                self.state = TURN[self.state]
                role = ROLE[self.state]
            elif edit == "K":
                self.state = KEPT[self.state, role[0]]
            out.append((edit, role, text))
        del self.held[:k]
        return out


class _Count:
    """What is counted of a conversation's rows as they come."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def report(self, repair: Repair) -> dict:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal, "cost": repair.cost, "audit": "".join(repair.audit)}


def with_faults(turns: DataFrame) -> DataFrame:
    """``fault`` of each row of ``conv_id, turn, role, text``: its first of blank, duplicate (of a row before it), truncated."""
    end = F.rtrim("text", F.lit(WHITE))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(end == "", BLANK).when(earlier, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    return turns.withColumn("fault", fault)


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``SCHEMA``: a row an edit (with the turn that it leaves, or that it deletes), in order within a partition, and after those of a conversation one with its report.

    Deleted rows that are blank or repeated have an empty text.
    """
    prepare(turns.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        repair = count = current = None

        def put(edits: list[tuple[str, str, str]]) -> None:
            nonlocal size
            for edit, role, text in edits:
                out.append((current, edit, role, text, None))
                size += len(text)

        def close() -> None:
            put(repair.finish())
            out.append((current, None, None, None, count.report(repair)))

        for rows in batches:
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if repair is None or conv != current:
                    if repair is not None:
                        close()
                    repair, count, current = Repair(block), _Count(), conv
                count.row(turn, role, fault)
                put(repair.feed(role, text, fault))
                if size > 1_000_000 or len(out) > 10_000:
                    yield _batch(out)
                    out, size = [], 0
        if repair is not None:
            close()
        if out:
            yield _batch(out)

    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = with_faults(turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text")))
    order = ["conv_id", "turn", "role", "text", F.col("fault") == DUPLICATE]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=["conv_id", "edit", "role", "text", "report"])


def repaired_turns(edits: DataFrame) -> DataFrame:
    """The turns that stay, of ``repair_conversations``: ``conv_id, role, text``, in order within a partition."""
    return edits.where(F.col("edit").isin("K", "R", "I")).select("conv_id", "role", "text")
