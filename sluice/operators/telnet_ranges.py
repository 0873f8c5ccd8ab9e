"""Telnet framing of one long flow by many tasks: the framing is a finite transducer, so what a range of slices does can be told before it is known where it begins.

A direction's bytes pass through five modes.  Each range of slices is run from each mode, which gives the mode it would end in and the records
it would end: a row a range.  Those few rows are put one after the other, which fixes every range's first mode and the number of its first record; then
the ranges are cut side by side, and the pieces of records that cross ranges are joined by their number.  Where a range begins comes to its task as
the range's first row, for after a join, Spark may leave out the shuffle that keeps a range in one task.  Results are those of ``terminal.frame_records``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stream import by_flow
from .ranges import WIDTH
from .terminal import RecordFramer

MODES = ("data", "command", "option", "sub", "sub command")
_CELL = ["flow_id", "side", "range"]


class _Counting(RecordFramer):
    """A framer that counts the ends of records, empty ones too."""

    def __init__(self, mode: str):
        super().__init__()
        self.mode, self.ended = mode, 0

    def end(self) -> bytes | None:
        self.ended += 1
        return None


class _Effects:
    """What a range does from each mode: the mode it ends in and the ends of records it meets."""

    def __init__(self):
        self.framers, self.of = [_Counting(m) for m in MODES], None

    def feed(self, row: tuple) -> list[tuple]:
        self.of = row[1:4]
        for f in self.framers:
            f.feed(row[4] or b"")
            f.record.clear()
        return []

    def finish(self) -> list[tuple]:
        return [(*self.of, [MODES.index(f.mode) for f in self.framers], [f.ended for f in self.framers])]


class _Chain:
    """One direction's ranges in order: where each begins."""

    def __init__(self):
        self.mode = self.records = 0

    def feed(self, row: tuple) -> list[tuple]:
        _, flow, side, at, ends, counts = row
        out = [(flow, side, at, self.mode, self.records)]
        self.mode, self.records = ends[self.mode], self.records + counts[self.mode]
        return out

    def finish(self) -> list[tuple]:
        return []


class _Cutting(RecordFramer):
    """A framer that gives every end of a record, empty ones too."""

    def end(self) -> bytes | None:
        return bytes(self.record)


class _Pieces:
    """A range's pieces of records: ``flow_id, side, number, range, piece, arrival, k, ts_us``; the time and place are those of the slice that ends a record, null for a piece that goes on.

    The first row is no slice, and tells where the range begins.
    """

    def __init__(self):
        self.framer, self.number, self.of = None, 0, None

    def feed(self, row: tuple) -> list[tuple]:
        _, flow, side, at, is_slice, mode, first, arrival, data, ts_us = row
        if not is_slice:
            self.framer, self.number, self.of = _Cutting(), first, (flow, side, at)
            self.framer.mode = MODES[mode]
            return []
        out = []
        for k, piece in enumerate(self.framer.feed(data or b"")):
            out.append((flow, side, self.number, at, piece, arrival, k, ts_us))
            self.number += 1
        return out

    def finish(self) -> list[tuple]:
        flow, side, at = self.of
        return [(flow, side, self.number, at, bytes(self.framer.record), None, None, None)] if self.framer.record else []


def frame_records(slices: DataFrame, width: int = WIDTH) -> DataFrame:
    """``flow_id, ord, protocol, type, data, ts_us``, by ranges of ``arrival`` of so many values."""
    rows = slices.select("flow_id", F.coalesce("from_client", F.lit(False)).cast("int").alias("side"), F.floor(F.col("arrival") / width).alias("range"), "arrival", "data", "ts_us")
    cell = F.to_json(F.struct(*_CELL)).alias("cell")
    effects = by_flow(rows.select(cell, *_CELL, "data", "arrival"), "cell", ["arrival"], _Effects, "flow_id string, side int, range long, ends array<int>, counts array<long>", [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())])
    direction = F.to_json(F.struct("flow_id", "side")).alias("direction")
    begins = by_flow(effects.select(direction, *_CELL, "ends", "counts"), "direction", ["range"], _Chain, "flow_id string, side int, range long, mode int, first long", [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()])
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = begins.select(cell, *_CELL, F.lit(False).alias("is_slice"), "mode", "first", none("long", "arrival"), none("binary", "data"), none("long", "ts_us"))
    headed = heads.union(rows.select(cell, *_CELL, F.lit(True).alias("is_slice"), none("int", "mode"), none("long", "first"), "arrival", "data", "ts_us"))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    pieces = by_flow(headed, "cell", ["is_slice", "arrival"], _Pieces, "flow_id string, side int, number long, range long, piece binary, arrival long, k int, ts_us long", kinds)
    data = F.expr("listagg(piece) WITHIN GROUP (ORDER BY range)")
    records = pieces.groupBy("flow_id", "side", "number").agg(data.alias("data"), F.max("arrival").alias("arrival"), F.max("k").alias("k"), F.max("ts_us").alias("ts_us"), F.count("k").alias("ended")).where("ended > 0 AND octet_length(data) > 0")
    # Records of both directions are numbered as they end, by ranges again.
    ended = records.withColumn("range", F.floor(F.col("arrival") / width))
    w = W.partitionBy("flow_id", "range")
    local = ended.withColumn("at", F.row_number().over(w.orderBy("arrival", "k")))
    counts = ended.groupBy("flow_id", "range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("flow_id").alias("_flow"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(W.partitionBy("flow_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = local.join(before, F.col("flow_id").eqNullSafe(F.col("_flow")) & (F.col("range") == F.col("_range")))
    return numbered.select("flow_id", (F.col("before") + F.col("at") - 1).alias("ord"), F.lit("TN3270").alias("protocol"), F.when(F.col("side") == 1, "REQUEST").otherwise("RESPONSE").alias("type"), "data", "ts_us")
