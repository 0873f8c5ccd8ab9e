"""Transactions of a stream of messages: both sides of each id, which may be used again, as ``reports.regroup`` gives them in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "tx_id string, use long, request binary, request_ts long, response binary, response_ts long"
_SIDES = ("REQUEST", "RESPONSE")


class _Transactions(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.side = handle.getMapState("side", "type string", "data binary, ts_us long")
        self.use = handle.getValueState("use", "n long")

    def _end(self, tx_id, held: dict) -> tuple:
        """The transaction with the sides it has, and none held any more."""
        stored = self.use.get()
        use = (stored[0] if stored else 0) + 1
        self.use.update((use,))
        return (tx_id, use, *(v for s in _SIDES for v in held.get(s, (None, None))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (None if v[0] is None else bytes(v[0]), v[1]) for k, v in self.side.iterator()}
        out = []
        for r in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples(index=False):
            held[r.type] = None if r.data is None else bytes(r.data), None if pd.isna(r.ts_us) else int(r.ts_us)
            if len(held) == 2:
                out.append(self._end(key[0], held))
                held = {}
        self.side.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        for kind, side in held.items():
            self.side.updateValue((kind,), side)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: (None if v[0] is None else bytes(v[0]), v[1]) for k, v in self.side.iterator()}
        self.side.clear()
        yield _frame([self._end(key[0], held)] if held else [])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in ("use", "request_ts", "response_ts")})


def transaction_stream(messages: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """Transactions of ``tx_id, ord, type, data, ts_us``, as soon as both sides are there; one that has waited ``wait_ms`` goes with the side it has.

    Batches come in order of ``ord`` within an id; ``use`` counts an id's transactions.  Needs the RocksDB state store.
    """
    rows = messages.select("tx_id", "ord", "type", "data", "ts_us").where(F.col("type").isin(*_SIDES))
    return rows.groupBy("tx_id").transformWithStateInPandas(_Transactions(wait_ms), OUTPUT, "Append", "ProcessingTime")


def as_transactions(flat: DataFrame) -> DataFrame:
    """The stream's rows with their sides as structs, null where one lacks."""
    side = lambda s: F.when(F.col(f"{s}_ts").isNotNull() | F.col(s).isNotNull(), F.struct(F.col(s).alias("data"), F.col(f"{s}_ts").alias("ts_us"))).alias(s)
    return flat.select("tx_id", "use", side("request"), side("response"))
