"""Reassembly of byte streams from segments in any order.

``assembled`` gives a direction's final bytes with windows alone; ``slices`` gives what each segment releases, in
arrival order, by the same per-flow machine that streaming uses.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stream import by_flow

def assembled(segments: DataFrame, keys: list[str], listed: str = "payload") -> DataFrame:
    """``keys, data``: the contiguous bytes from the first arriving payload on; earlier bytes win where segments overlap.

    A segment adds bytes beyond the frontier, the running maximum of ends in sequence order; a gap ends the stream.
    """
    s = segments.where(F.octet_length(listed) > 0).select(*keys, "arrival", "seq", F.col(listed).alias("p"))
    s = s.select("*", F.first("seq").over(W.partitionBy(*keys).orderBy("arrival").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("base"))
    s = s.select("*", (F.col("seq") + F.octet_length("p")).alias("end"), F.greatest("seq", "base").alias("st")).where("end > base")
    w = W.partitionBy(*keys).orderBy("st", "arrival")
    s = s.select("*", F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("base")).alias("frontier"))
    s = s.select("*", F.sum((F.col("st") > F.col("frontier")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("gaps"))
    s = s.where("gaps = 0 AND end > frontier").select(*keys, "st", "arrival", F.expr("substring(p, CAST(greatest(st, frontier) - seq + 1 AS INT))").alias("piece"))
    return s.groupBy(*keys).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY st, arrival)").alias("data"))


class Reassembler:
    """One direction of a flow: released bytes never come again; of buffered bytes the older win on the left, the newer on the right.

    Each waiting piece keeps the time at which it came.  What is released at once has the time of its last piece in order of sequence,
    which may have come before the one that closed the gap.
    """

    def __init__(self, frontier: int | None = None, waiting: dict[int, tuple[bytes, int]] | None = None):
        self.frontier, self.waiting = frontier, dict(waiting or {})

    def held(self) -> int:
        return sum(len(data) for data, _ in self.waiting.values())

    def accept(self, seq: int | None, data: bytes, ts_us: int = 0) -> tuple[bytes, int]:
        """Bytes that ``data`` at ``seq`` releases and their time; no bytes if it is old, waits for a gap to close or has no place."""
        if not data or seq is None:
            return b"", ts_us
        if self.frontier is None:
            self.frontier = seq
        if seq < self.frontier:
            data, seq = data[self.frontier - seq :], self.frontier
        if not data:
            return b"", ts_us
        for at in sorted(self.waiting):
            old = self.waiting[at][0]
            if at <= seq < at + len(old):
                skip = at + len(old) - seq
                data, seq = data[skip:], seq + skip
                if not data:
                    return self._release(ts_us)
        end = seq + len(data)
        for at in sorted(a for a in self.waiting if seq <= a < end):
            old, old_ts = self.waiting.pop(at)
            if at + len(old) > end:
                self.waiting[end] = old[end - at :], old_ts
        self.waiting[seq] = data, ts_us
        return self._release(ts_us)

    def _release(self, ts_us: int) -> tuple[bytes, int]:
        out = b""
        while (piece := self.waiting.pop(self.frontier, None)) is not None:
            out, ts_us = out + piece[0], piece[1]
            self.frontier += len(piece[0])
        return out, ts_us


class Sides:
    """Both directions of a flow; rows are ``flow_id, arrival, from_client, seq, payload, ts_us``."""

    def __init__(self):
        self.streams: dict[bool, Reassembler] = {}

    def feed(self, row: tuple) -> list[tuple]:
        flow, arrival, from_client, seq, payload, ts_us = row
        side = bool(from_client)
        got, at = self.streams.setdefault(side, Reassembler()).accept(seq, payload or b"", ts_us)
        return [(flow, arrival, side, got, at)] if got else []

    def finish(self) -> list[tuple]:
        return []


SLICE = "flow_id string, arrival long, from_client boolean, data binary, ts_us long"


def slices(oriented: DataFrame, mode: str = "sequence") -> DataFrame:
    """What each arriving segment releases of its flow, both directions; ``mode="arrival"`` takes payloads as they come, repeats too."""
    if mode == "arrival":
        return oriented.where(F.octet_length("payload") > 0).select("flow_id", "arrival", "from_client", F.col("payload").alias("data"), "ts_us")
    if mode != "sequence":
        raise ValueError(f"unknown mode: {mode}")

    rows = oriented.select("flow_id", "arrival", "from_client", "seq", "payload", "ts_us")
    return by_flow(rows, "flow_id", ["arrival"], Sides, SLICE, [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()])


OUTCOME = "flow_id string, arrival long, from_client boolean, duplicate boolean, stored boolean, buffered boolean, contiguous boolean, n_bytes long"


class _Outcomes:
    """What becomes of each segment of a flow."""

    def __init__(self):
        self.streams: dict[bool, Reassembler] = {}

    def feed(self, row: tuple) -> list[tuple]:
        flow, arrival, from_client, seq, payload = row
        stream = self.streams.setdefault(bool(from_client), Reassembler())
        if not payload or seq is None:
            return [(flow, arrival, bool(from_client), False, False, False, False, 0)]
        before = stream.held()
        got, _ = stream.accept(seq, payload)
        stored = stream.held() + len(got) > before
        return [(flow, arrival, bool(from_client), not stored, stored, not got, bool(got), len(got))]

    def finish(self) -> list[tuple]:
        return []


def outcomes(oriented: DataFrame) -> DataFrame:
    """A row a segment: whether it was a duplicate or brought bytes (``stored``), and whether bytes were released (``contiguous``) or, though it had some, weren't (``buffered``)."""
    rows = oriented.select("flow_id", "arrival", "from_client", "seq", "payload")
    return by_flow(rows, "flow_id", ["arrival"], _Outcomes, OUTCOME, [pa.string(), pa.int64(), *[pa.bool_()] * 5, pa.int64()])
