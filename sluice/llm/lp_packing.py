"""Best-fit packing by a configuration linear program.

A configuration is a multiset of lengths that fits into a sequence.  The program asks for the least number of sequences, in fractions of
configurations, that covers the histogram of lengths.  Multiplicative weights solve it: a length's price is its size,
lowered exponentially as it gets covered.  Each round a knapsack by dynamic programming finds the best value of every room under these
prices, so one table gives, for each length that isn't covered yet, the best configuration that holds it; those
near the best price are raised until one of their lengths has its share of the round.  By duality, the histogram's price over the best configuration's
is a lower bound on the sequences that any packing needs; the plan carries the best one found.

Rounding takes each configuration in turn, up to its fraction rounded up and as often as its lengths last, and lays out what is left
by best fit, the largest length first, in patterns as often as they last.  Of three orders the one with the fewest sequences stays.

The histogram has at most ``capacity`` lengths whatever the corpus, and the plan at most ``COLUMNS`` configurations and the patterns of the rest, so they are the driver's.
Pieces never leave Spark: each is numbered among those of its length (in its partition, then by sums over partitions), and the number says
which sequence of which configuration it lies in.

Defined cases: null text is empty and gives its end id alone; rows with a null or repeated id are packed like others under that id;
other columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import Scratch, prepare
from ._tokens import word_encoder
from ._words import binary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: The share of a length that a round may cover, how fast a covered length's price falls, how near to the best price a configuration has to be.
SHARE, FALL, NEAR = 0.1, 0.5, 0.02
#: Rounds at most, rounds before the first plan (the next ones follow at powers of two), and the distance from the lower bound, as a share, that ends them.
ROUNDS, FIRST, GAP = 128, 4, 0.0005
#: Configurations of the program that are rounded at most; best fit lays out what they would have held.
COLUMNS = 20_000

Pattern = tuple[tuple[int, int], ...]  # places among the lengths, ascending, and times


@dataclass
class Plan:
    """Patterns with copies, over ``lengths``, that hold each length exactly ``counts`` times."""

    lengths: np.ndarray
    counts: np.ndarray
    patterns: list[tuple[Pattern, int]]
    lower_bound: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best price of each room from 0 to ``capacity``, and the length (its place) that a best filling has, -1 where one place less does as well."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            prices_here = best[room - lengths[:n]] + prices[:n]
            # of equal prices the largest length, which leaves the small ones for other rooms
            j = n - 1 - int(prices_here[::-1].argmax())
            if prices_here[j] > best[room] + 1e-12:
                best[room], choice[room] = prices_here[j], j
    return best, choice


def filling(room: int, choice: np.ndarray, lengths: np.ndarray) -> list[int]:
    out = []
    while room > 0:
        j = int(choice[room])
        if j < 0:
            room -= 1
        else:
            out.append(j)
            room -= int(lengths[j])
    return out


def _pattern(places: list[int]) -> Pattern:
    return tuple((j, len(list(same))) for j, same in groupby(sorted(places)))


def fractions(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> Iterator[tuple[dict[Pattern, float], float]]:
    """After each round of multiplicative weights: the program's solution, scaled to cover the median length once, and the best lower bound so far."""
    covered = np.zeros(len(lengths))
    x: dict[Pattern, float] = {}
    bound = 0.0
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-FALL * (covered - covered.min()))
        best, choice = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ counts) / float(best[capacity]))
        values = prices + best[capacity - lengths]
        quota = SHARE * counts.astype(float)
        for j in np.lexsort((-lengths, -values)).tolist():
            if values[j] < (1 - NEAR) * best[capacity]:
                break
            if quota[j] <= 0:
                continue
            pattern = _pattern([j, *filling(capacity - int(lengths[j]), choice, lengths)])
            times = min(quota[i] / a for i, a in pattern)
            if times > 0:
                x[pattern] = x.get(pattern, 0.0) + times
                for i, a in pattern:
                    quota[i] = max(0.0, quota[i] - times * a)
                    covered[i] += times * a / counts[i]
        level = max(1.0, float(np.median(covered)))
        yield {p: n / level for p, n in x.items()}, bound


def best_fit(lengths: np.ndarray, left: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns for what is ``left``: the largest length, then the largest that fits beside, as often as they last."""
    there = [j for j, n in enumerate(left) if n]
    sizes = [int(lengths[j]) for j in there]
    out = []
    while there:
        room, pattern, at = capacity, [], len(there)
        while at and room:
            at = bisect_right(sizes, room, 0, at) - 1
            if at < 0:
                break
            j = there[at]
            n = min(left[j], room // sizes[at])
            pattern.append((j, n))
            room -= n * sizes[at]
        copies = min(left[j] // n for j, n in pattern)
        for j, n in pattern:
            left[j] -= copies * n
        out.append((tuple(reversed(pattern)), copies))
        gone = [j for j, _ in pattern if not left[j]]
        for j in gone:
            k = bisect_right(there, j) - 1
            del there[k], sizes[k]
    return out


def rounded(x: dict[Pattern, float], order, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    left = [int(n) for n in counts]
    out = []
    for pattern in sorted(x, key=order)[:COLUMNS]:
        copies = min(int(np.ceil(x[pattern] - 1e-9)), *(left[j] // n for j, n in pattern), 1 << 62)
        if copies:
            for j, n in pattern:
                left[j] -= copies * n
            out.append((pattern, copies))
    return out + best_fit(lengths, left, capacity)


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Plan:
    """The patterns for a histogram: ``lengths`` ascending, all from 1 to ``capacity``, with ``counts`` above 0."""
    made = Plan(lengths, counts, [], 0.0)
    if not len(lengths):
        return made
    for k, (x, bound) in enumerate(fractions(lengths, counts, capacity, rounds), 1):
        if k == rounds or k & (k - 1) == 0 and k >= FIRST:
            size = {p: sum(int(lengths[j]) * n for j, n in p) for p in x}
            for order in (lambda p: (-size[p], -x[p], p), lambda p: (-p[-1][0], -size[p], p), lambda p: (-x[p], p)):  # noqa: B023
                found = rounded(x, order, lengths, counts, capacity)
                if not made.patterns or sum(n for _, n in found) < made.sequences:
                    made.patterns = found
            made.lower_bound = bound
            if made.sequences <= np.ceil(bound - 1e-6) * (1 + GAP):
                break
    return made


class Layout:
    """Where the k-th piece of a length lies under a plan."""

    def __init__(self, made: Plan):
        runs = []
        sequence = 0
        for pattern, copies in made.patterns:
            offset = 0
            for j, n in reversed(pattern):
                runs.append((j, sequence, n, offset, copies * n))
                offset += int(made.lengths[j]) * n
            sequence += copies
        runs.sort(key=lambda r: r[:2])
        self.sequence, self.times, self.offset = (np.asarray([r[c] for r in runs], dtype=np.int64) for c in (1, 2, 3))
        self.edges = np.concatenate(([0], np.cumsum([r[4] for r in runs]))).astype(np.int64)
        self.first = np.zeros(int(made.lengths[-1]) + 1 if len(made.lengths) else 1, dtype=np.int64)
        self.first[made.lengths] = np.concatenate(([0], np.cumsum(made.counts)[:-1]))

    def __call__(self, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + place
        run = np.searchsorted(self.edges, at, "right") - 1
        within = at - self.edges[run]
        return self.sequence[run] + within // self.times[run], self.offset[run] + within % self.times[run] * length


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PIECES``: documents cut only beyond the capacity; ``place`` numbers the pieces of a length within a partition, ``part``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(binary(batch.column(1)).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(work, PIECES)


def pack(docs: DataFrame, tokenizer: str, scratch: Scratch, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document lies: ``SCHEMA``, a row a piece."""
    prepare(docs.sparkSession)
    cut = scratch.table(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    held = scratch.table(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = held.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toArrow()  # at most ``capacity`` rows
    layout = Layout(plan(histogram.column(0).to_numpy(), histogram.column(1).to_numpy(), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    placed = cut.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("base")).alias("place"))
    return placed.mapInArrow(place, SCHEMA)
