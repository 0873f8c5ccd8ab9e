"""Harmonic packing of token ids into fixed-length sequences.

A document of more than ``capacity // (k + 1)`` and at most ``capacity // k`` tokens is of class k, and each bin of the class
takes k whole documents.  Longer ones give full sequences first.  What a bin of k documents has left is padding if it is
at most ``slack`` tokens; else it is filled from a filler, one document at a time that is cut for this: the tail of a long
document, or the next one that comes.  So only fillers and long documents are cut.

Workers fill the bins of each class on their own: no shuffle, and one open bin a class and worker.  What a worker's open
bins hold when its documents end is laid end to end, cut at the capacity, and the last sequence is cut at powers of
two, which need no padding.

Defined cases: null text is empty and gives its end id alone; rows with a null or repeated id are packed
like others under that id; other columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import prepare
from ._tokens import word_encoder
from ._words import binary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class_size long"
#: Sequences that one worker may make, beyond which ids would meet the next worker's.
PER_WORKER = 1 << 33
#: Tails of long documents that wait as fillers at most, in sequences; more of them are packed like other documents.
FILLERS = 8

Piece = tuple  # document, start, ids as bytes, tokens of the document


class HarmonicPacker:
    def __init__(self, capacity: int, first_sequence: int, slack: int):
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list[Piece]] = {}
        self.fillers: list[Piece] = []
        self.waiting: list[tuple[int, list[Piece]]] = []  # full bins with room, while there is no filler
        self.next, self.limit = first_sequence, first_sequence + PER_WORKER

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start > self.capacity:
            yield from self._close([(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)], 1)
            start += self.capacity
        piece = (doc, start, ids[4 * start :], total)
        if self.waiting or (start and sum(_size(f) for f in self.fillers) < FILLERS * self.capacity):
            self.fillers.append(piece)
            waiting, self.waiting = self.waiting, []
            for k, held in waiting:
                yield from self._fill(k, held)
            return
        k = self.capacity // _size(piece)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            yield from self._fill(k, self.open.pop(k))

    def _fill(self, k: int, held: list[Piece]) -> Iterator[tuple]:
        """Close a bin that has its documents, with pieces of fillers if much room is left."""
        room = self.capacity - sum(map(_size, held))
        while room > self.slack:
            if not self.fillers:
                self.waiting.append((k, held))
                return
            doc, start, ids, total = self.fillers.pop()
            n = min(room, len(ids) // 4)
            held.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                self.fillers.append((doc, start + n, ids[4 * n :], total))
            room -= n
        yield from self._close(held, k)

    def _close(self, held: list[Piece], k: int) -> Iterator[tuple]:
        if self.next >= self.limit:
            raise OverflowError(f"a worker makes {PER_WORKER} sequences at most")
        offset = 0
        for doc, start, ids, total in held:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset, k
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        """What the open bins, waiting bins and fillers hold, end to end."""
        rest = [p for _, held in self.waiting for p in held] + [p for k in sorted(self.open) for p in self.open[k]] + self.fillers
        self.open, self.waiting, self.fillers = {}, [], []
        left = sum(map(_size, rest))
        held: list[Piece] = []
        room = 0
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    yield from self._close(held, 0)
                    held = []


def _size(piece: Piece) -> int:
    return len(piece[2]) // 4


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", slack: int | None = None) -> DataFrame:
    """Where each piece of each document lies: a row a piece, ``SCHEMA``; class_size is the bin's class, 0 for the workers' last bins.

    ``slack`` is a bin's padding that is taken rather than a document cut, by default a 64th of the capacity.
    """
    prepare(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() * PER_WORKER, capacity // 64 if slack is None else slack)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(binary(batch.column(1)).to_pylist()), strict=True):
                rows.extend(packer.add(doc, ids + end))
            if rows:
                yield emit(rows)
        if rows := list(packer.finish()):
            yield emit(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, SCHEMA)
