"""Raw segments as a stream to pairs, by the same machine as in batch.

State is a conversation's: who the client is, frontiers and waiting bytes, framing buffers, open requests (``_state.py`` says how it is
kept).  A conversation that stays silent for ``ttl_ms`` is given up; what it still held is counted in a row of ``dropped_bytes``.

``arrival`` orders the segments of a batch.  Batches come in order of arrival, as from one partition of a bus by conversation; or else
``disorder`` says how far, in arrivals, a segment may come after later ones: then rows wait in state until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.engine import COLUMNS, Conversation
from ..operators.flows import conversation
from ..operators.protocols import KNOWN, Protocol
from ._state import Kept

OUTPUT = "conv string, flow_id string, protocol string, n long, request binary, request_ts long, response binary, response_ts long, client_ip string, client_port long, server_ip string, server_port long, dropped_bytes long"


def _flat(row: tuple) -> tuple:
    conv, flow, protocol, n, request, response, client, server, dropped = row
    q, p = request or {"data": None, "ts_us": None}, response or {"data": None, "ts_us": None}
    return conv, flow, protocol, n, q["data"], q["ts_us"], p["data"], p["ts_us"], client["ip"], client["port"], server["ip"], server["port"], dropped


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    for r in frame.sort_values("arrival", kind="stable")[list(COLUMNS)].itertuples(index=False):
        yield r.conv, int(r.arrival), r.src_ip, int(r.src_port), r.dst_ip, int(r.dst_port), int(r.seq), int(r.flags), r.payload, int(r.ts_us)


class _Conversations(StatefulProcessor):
    def __init__(self, enabled: tuple[str, ...] | None, protocols: tuple[Protocol, ...], ttl_ms: int | None):
        self.enabled, self.protocols, self.ttl_ms = enabled, protocols, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = Kept(handle, "conversation")

    def _feed(self, rows: Iterator[tuple]) -> list[tuple]:
        machine = self.kept.load() or Conversation(self.enabled, self.protocols)
        out = [_flat(found) for row in rows for found in machine.feed(row)]
        self.kept.save(machine)
        return out

    def _timer(self, at: int) -> None:
        """The only timer of a key."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _give_up(self, key) -> list[tuple]:
        machine = self.kept.load()
        held = machine.held() if machine else 0
        self.kept.clear()
        return [(key[0], *[None] * 11, held)] if held else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = self._feed(_rows(pd.concat(list(rows))))
        if self.ttl_ms is not None:
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._give_up(key))

    def close(self) -> None:
        pass


class _Waiting(_Conversations):
    """Rows wait by arrival until the watermark is past them; then they are fed in order. A millisecond of the watermark is 1000 arrivals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.early = handle.getMapState("early", "arrival long, copy long", "src_ip string, src_port int, dst_ip string, dst_port int, seq long, flags int, payload binary, ts_us long")
        self.last = handle.getValueState("last", "ms long")

    def _release(self, conv: str, watermark: int) -> list[tuple]:
        """Feed what the watermark has passed, and set the timer: to the first row that waits, or to when the conversation is given up."""
        ready = sorted(k for k in self.early.keys() if k[0] // 1000 < watermark)
        out: list[tuple] = []
        if ready:
            out = self._feed((conv, k[0], *self.early.getValue(k)) for k in ready)
            for k in ready:
                self.early.removeKey(k)
            self.last.update((ready[-1][0] // 1000,))
        first = min((k[0] // 1000 for k in self.early.keys()), default=None)
        last = self.last.get()
        if first is not None:
            self._timer(first + 1)
        elif self.ttl_ms is not None:
            self._timer((last[0] if last else watermark) + self.ttl_ms)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for row in _rows(pd.concat(list(rows))):
            copy = 0
            while self.early.containsKey((row[1], copy)):
                copy += 1
            self.early.updateValue((row[1], copy), (*row[2:8], bytes(row[8] or b""), row[9]))
        yield _frame(self._release(key[0], timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waited = any(True for _ in self.early.keys())
        if waited:
            yield _frame(self._release(key[0], timerValues.getCurrentWatermarkInMs()))
        else:
            self.last.clear()
            yield _frame(self._give_up(key))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split() for c in OUTPUT.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in names]).astype({n: "Int64" for n, kind in names if kind == "long"})


def pair_stream(segments: DataFrame, enabled: tuple[str, ...] | None = None, protocols: tuple[Protocol, ...] = KNOWN, ttl_ms: int | None = 600_000, disorder: int | None = None) -> DataFrame:
    """Pairs of a stream of raw segments, flat columns. Needs the RocksDB state store.

    The source's limits (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) hold back what a batch takes; the checkpoint makes state and output
    start again where they stood.  With ``ttl_ms`` None nothing is given up; ``availableNow`` then ends when the source is exhausted, while
    clocks in state may keep a query of several batches running.

    With ``disorder`` pairs are those of all segments in order of arrival, however batches mix them, as long as none comes more than so
    many arrivals after a later one; segments that do are dropped as late.  Silence then counts in arrivals too, 1000 of them for one of ``ttl_ms``, and
    the last ``disorder`` segments wait until others come.
    """
    rows = conversation(segments).select(*COLUMNS)
    if disorder is None:
        return rows.groupBy("conv").transformWithStateInPandas(_Conversations(enabled, protocols, ttl_ms), OUTPUT, "Append", "None" if ttl_ms is None else "ProcessingTime")
    timed = rows.withColumn("arrived", F.timestamp_micros("arrival")).withWatermark("arrived", f"{disorder} microseconds")
    return timed.groupBy("conv").transformWithStateInPandas(_Waiting(enabled, protocols, ttl_ms), OUTPUT, "Append", "EventTime")


def as_pairs(flat: DataFrame) -> DataFrame:
    """The stream's rows with a pair, in the columns of the batch."""
    side = lambda s: F.struct(F.col(s).alias("data"), F.col(f"{s}_ts").alias("ts_us")).alias(s)
    end = lambda s: F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").cast("int").alias("port")).alias(s)
    return flat.where("n IS NOT NULL").select("conv", "flow_id", "protocol", "n", side("request"), side("response"), end("client"), end("server"))


def in_memory(rows: DataFrame, name: str, checkpoint: str):
    """A stream's rows as the table ``name`` of the session, a snapshot whenever it is read. For tests and small streams: the driver holds them."""
    return rows.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()


def discard(rows: DataFrame) -> None:
    """Compute all rows and keep none."""
    rows.write.format("noop").mode("overwrite").save()
