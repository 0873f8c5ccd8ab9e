"""Terminal sessions as a stream: pairs to screens and submits, by the same machine as in batch, and to terminal events.

State is a session's: its partitions and the last screen, which a submit answers; no second join is needed for that.  A session that stays idle
for ``idle_ms`` ends: an event says so, with the time of the last thing it did, and a later pair begins it anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.terminal import FIELD, Session
from ._state import Kept

_TEXT = ("session_id", "type", "aid", "inputs", "plain_text", "fields", "screen_hash", "screen_name", "session_key", "seen_text", "seen_hash", "seen_name")
_NUMBERS = ("n", "ts_us", "rows", "cols", "seen_rows", "seen_cols")
OUTPUT = ", ".join([*(f"{c} string" for c in _TEXT), *(f"{c} long" for c in _NUMBERS)])
_EVENT = ("session_id", "n", "type", "ts_us", "aid", "inputs", "rows", "cols", "plain_text", "fields", "screen_hash", "screen_name", "session_key")
_SEEN = {"seen_rows": "rows", "seen_cols": "cols", "seen_text": "plain_text", "seen_hash": "screen_hash", "seen_name": "screen_name"}


class Seeing:
    """A session, and what its user has before the eyes: the last screen since its start."""

    def __init__(self):
        self.session, self.screen, self.last = Session(None), None, 0

    def _event(self, row: tuple) -> dict:
        e = dict(zip(_EVENT, row, strict=True))
        if e["type"] == "SCREEN_RENDER":
            self.screen = {k: e[c] for k, c in _SEEN.items()}
        elif e["type"] != "USER_SUBMIT":
            self.screen = None
        self.last = max(self.last, e["ts_us"] or 0)
        seen = self.screen if e["type"] == "USER_SUBMIT" and self.screen else dict.fromkeys(_SEEN)
        as_json = {k: None if e[k] is None else json.dumps(dict(e[k]) if k == "inputs" else e[k]) for k in ("inputs", "fields")}
        return e | as_json | seen

    def feed(self, row: tuple) -> list[dict]:
        return [self._event(x) for x in self.session.feed(row)]

    def end(self) -> list[dict]:
        self.session.close_ts = self.last
        return [self._event(x) for x in self.session.finish()] if self.session.key is not None else []


class _Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = Kept(handle, "session")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = self.kept.load() or Seeing()
        out = []
        for r in pd.concat(list(rows)).sort_values("n").itertuples(index=False):
            side = lambda data, ts: {"data": bytes(data or b""), "ts_us": None if pd.isna(ts) else int(ts)}
            out += machine.feed((r.flow_id, int(r.n), side(r.request, r.request_ts), side(r.response, r.response_ts)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.kept.save(machine)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self.kept.load()
        self.kept.clear()
        yield _frame(machine.end() if machine else [])

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*_TEXT, *_NUMBERS]).astype({c: "Int64" for c in _NUMBERS})


def session_stream(pairs: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """Events of terminal sessions (flows) from a stream of ``flow_id, n, request, request_ts, response, response_ts``, whose batches come in order of ``n``.

    The columns are the batch's, and ``screen``: for a submit the session's last screen.  Needs the RocksDB state store.
    """
    rows = pairs.select("flow_id", "n", "request", "request_ts", "response", "response_ts")
    flat = rows.groupBy("flow_id").transformWithStateInPandas(_Sessions(idle_ms), OUTPUT, "Append", "ProcessingTime")
    screen = F.struct(F.col("seen_rows").cast("int").alias("rows"), F.col("seen_cols").cast("int").alias("cols"), F.col("seen_text").alias("plain_text"), F.col("seen_hash").alias("screen_hash"), F.col("seen_name").alias("screen_name"))
    return flat.select(
        "session_id", "n", "type", "ts_us", "aid", F.from_json("inputs", "map<string,string>").alias("inputs"), F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"), "plain_text",
        F.from_json("fields", f"array<struct<{FIELD}>>").alias("fields"), "screen_hash", "screen_name", "session_key", F.when(F.col("seen_rows").isNotNull(), screen).alias("screen"),
    )


def user_event_stream(events: DataFrame, rules: list[dict], app: str = "tn3270", source: str = "tn3270", keep: tuple[str, ...] = ()) -> DataFrame:
    """Submits of ``session_stream`` as terminal events, as ``screens.terminal_user_events`` gives them."""
    from ..operators.screens import published

    return published(events.where("type = 'USER_SUBMIT' AND screen IS NOT NULL"), rules, app, source, keep)
