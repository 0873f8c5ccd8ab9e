"""TN3270: telnet records, the terminal's screen as host and user change it, and its events.

``RecordFramer`` cuts a byte stream into records, ``Screen`` holds one session's presentation spaces, and
``terminal_events`` runs both over the message pairs of each session.  Only a record's own bytes are parsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ebcdic
from ..functions.binary import murmur128_hex
from ._stream import by_flow
from .http import MESSAGE, MESSAGE_KINDS, Framing

# Telnet commands, 3270 commands, orders, structured fields and attribute bits.
IAC, SB, SE, EOR = 0xFF, 0xFA, 0xF0, 0xEF
NEGOTIATE = (0xFB, 0xFC, 0xFD, 0xFE)
WRITE, ERASE_WRITE, STRUCTURED = 0xF1, 0xF5, 0xF3
SF, SBA, EUA, IC = 0x1D, 0x11, 0x12, 0x13
READ_BUFFER, READ_PARTITION, QUERY_REPLY = 0x02, 0x04, 0x81
PROTECTED, NUMERIC, HIDDEN_MASK, HIDDEN = 0x20, 0x10, 0x0C, 0x0C
CLEAR = 0x40
# Attention identifiers.
AID = {0x7D: "ENTER", 0x6D: "CLEAR", 0x6C: "PA1", 0x6B: "PA2", 0x6A: "PA3"}
# White space that ends of lines, labels and values lose.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
AID |= {0xF0 + n: f"PF{n}" for n in range(1, 13)} | {0xC0 + n: f"PF{12 + n}" for n in range(1, 13)}


class RecordFramer:
    """Telnet bytes of one direction into records that end with an end-of-record mark; state lasts between slices."""

    def __init__(self):
        self.record, self.mode = bytearray(), "data"

    def held(self) -> int:
        return len(self.record)

    def end(self) -> bytes | None:
        """What a mark at the end of a record gives: the record, unless it is empty."""
        return bytes(self.record) or None

    def feed(self, data: bytes) -> list[bytes]:
        """Runs without 0xFF are taken whole; only commands are looked at byte by byte."""
        out, at, n = [], 0, len(data)
        while at < n:
            if self.mode in ("data", "sub"):
                mark = data.find(IAC, at)
                end = n if mark < 0 else mark
                if self.mode == "data":
                    self.record += data[at:end]
                if mark >= 0:
                    self.mode = "command" if self.mode == "data" else "sub command"
                at = end + 1
                continue
            b = data[at]
            at += 1
            if self.mode == "command":
                self.mode = "data"
                if b == IAC:
                    self.record.append(IAC)
                elif b == SB:
                    self.mode = "sub"
                elif b in NEGOTIATE:
                    self.mode = "option"
                elif b == EOR:
                    if (record := self.end()) is not None:
                        out.append(record)
                    self.record.clear()
            elif self.mode == "option":
                self.mode = "data"
            else:
                self.mode = "data" if b == SE else "sub"
        return out


def filter_telnet(record: bytes) -> bytes:
    """A record without telnet commands, unescaped once more."""
    framer = RecordFramer()
    ended = framer.feed(record)
    return b"".join(ended) + bytes(framer.record)


def frame_records(slices: DataFrame) -> DataFrame:
    """``flow_id, ord, protocol, type, data, ts_us``: records of each flow; the host's are responses."""
    return by_flow(slices.select("flow_id", "arrival", "from_client", "data", "ts_us"), "flow_id", ["arrival"], lambda: Framing("TN3270", lambda side: RecordFramer()), MESSAGE, MESSAGE_KINDS)


def address(high: int, low: int) -> int:
    return (high & 0x3F) << 6 | low & 0x3F


@dataclass
class Field:
    at: int
    attribute: int
    start: int = 0
    end: int = 0
    label: str | None = None
    modified: bool = False

    @property
    def protected(self) -> bool:
        return bool(self.attribute & PROTECTED)

    @property
    def numeric(self) -> bool:
        return bool(self.attribute & NUMERIC)

    @property
    def hidden(self) -> bool:
        return self.attribute & HIDDEN_MASK == HIDDEN


@dataclass
class Partition:
    """One presentation space of a terminal."""

    rows: int = 24
    cols: int = 80
    buffer: bytearray = field(default_factory=bytearray)
    fields: dict[int, Field] = field(default_factory=dict)
    cursor: int = 0
    hash: str | None = None

    def __post_init__(self):
        self.clear()

    def clear(self) -> None:
        self.buffer = bytearray([ebcdic.SPACE]) * (self.rows * self.cols)
        self.fields.clear()
        self.cursor, self.hash = 0, None


class Screen:
    """A terminal: its partitions, of which structured fields make one the active, and the name of its first screen."""

    def __init__(self):
        self.partitions = {0: Partition()}
        self.active = self.partitions[0]
        self.name: str | None = None

    rows = property(lambda self: self.active.rows)
    cols = property(lambda self: self.active.cols)
    buffer = property(lambda self: self.active.buffer)
    fields = property(lambda self: self.active.fields)

    def _shape(self, number: int, rows: int, cols: int, clear: bool) -> None:
        """Make a partition the active one, with the rows and columns given where they aren't 0."""
        self.active = p = self.partitions.setdefault(number, Partition())
        shape = rows or p.rows, cols or p.cols
        if clear or shape != (p.rows, p.cols):
            p.rows, p.cols = shape
            p.clear()
        p.fields.clear()

    def host_write(self, data: bytes) -> dict:
        """Apply a host's record and take a snapshot; one that is no write only takes it."""
        if len(data) > 1 and data[0] in (WRITE, ERASE_WRITE, STRUCTURED):
            if data[0] == STRUCTURED:
                if data[1] & CLEAR:
                    self.active.clear()
                self._structured(data[2:])
            else:
                if data[0] == ERASE_WRITE or data[1] & CLEAR:
                    self.active.clear()
                else:
                    self.fields.clear()
                self._orders(data[2:])
            self._span()
            shot = self.snapshot()
            self.active.hash = shot["screen_hash"]
            return shot
        return self.snapshot()

    def _structured(self, data: bytes) -> None:
        at = 0
        while len(data) - at >= 3:
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 3 or at + size > len(data):
                return
            kind, body = data[at + 2], data[at + 3 : at + size]
            at += size
            if kind == QUERY_REPLY and len(body) >= 3:
                self._shape(body[0], body[1], body[2], False)
            elif kind in (READ_BUFFER, READ_PARTITION) and len(body) >= 4:
                self._shape(body[0], body[2], body[3], kind == READ_BUFFER or bool(body[1] & CLEAR))
                self._orders(body[4:])

    def _orders(self, data: bytes) -> None:
        size, to, at = self.rows * self.cols, 0, 0
        while at < len(data):
            b = data[at]
            at += 1
            if b in (SBA, EUA):
                if at + 2 > len(data):
                    return
                target = address(data[at], data[at + 1])
                at += 2
                if b == EUA and target != to:
                    for k in range((target - to) % size):
                        self.buffer[(to + k) % size] = ebcdic.SPACE
                to = target
            elif b == SF:
                if at == len(data):
                    return
                to %= size
                self.fields[to] = Field(to, data[at])
                self.buffer[to] = data[at]
                to, at = (to + 1) % size, at + 1
            elif b == IC:
                self.active.cursor = to
            else:
                self.buffer[to % size] = b
                to = (to + 1) % size

    def _span(self) -> None:
        """A field reaches from after its attribute to the next one's; its label is the word before it in its row."""
        marks = sorted(self.fields)
        for k, at in enumerate(marks):
            f = self.fields[at]
            f.start, f.end = at + 1, marks[k + 1] if k + 1 < len(marks) else self.rows * self.cols
            f.label = self._label(at)

    def _label(self, at: int) -> str | None:
        """What stands before the attribute in the row of the cell before it, up to a space or a control byte."""
        k = at - 1
        if k < 0:
            return None
        first = k - k % self.cols
        while k >= first and self.buffer[k] == ebcdic.SPACE:
            k -= 1
        end = k + 1
        while k >= first and self.buffer[k] > ebcdic.SPACE:
            k -= 1
        return ebcdic.decode(self.buffer[k + 1 : end]).rstrip(WHITE) or None

    def _value(self, f: Field) -> str:
        return ebcdic.decode(self.buffer[f.start : f.end]).rstrip(WHITE)

    def snapshot(self) -> dict:
        """The screen as it is held: NULs and attribute bytes are characters like others, and count in the hash."""
        text = ebcdic.decode(self.buffer)
        lines = [text[r * self.cols : (r + 1) * self.cols].rstrip(WHITE) for r in range(self.rows)]
        fields = [{"start": f.start, "length": f.end - f.start, "protected": f.protected, "numeric": f.numeric, "hidden": f.hidden, "value": self._value(f)} for _, f in sorted(self.fields.items()) if f.end > f.start]
        fixed = [f["value"] for f in fields if f["protected"]]
        digest = murmur128_hex("".join(v + "|" for v in fixed).encode()) if fixed else None
        if not self.name:
            named = next((v for v in fixed if v.strip()), lines[0] if lines else "")
            self.name = re.sub("[^A-Za-z0-9]+", " ", named).strip().upper().replace(" ", "_") or None
        return {"rows": self.rows, "cols": self.cols, "plain_text": "\n".join(lines), "fields": fields, "screen_hash": digest, "screen_name": self.name}

    def submit(self, data: bytes) -> tuple[str, dict[str, str]]:
        """The attention key and what was typed into unprotected, visible fields, by label or address."""
        if not data:
            return "UNKNOWN", {}
        inputs: dict[str, str] = {}
        if len(data) >= 3:
            self.active.cursor = address(data[1], data[2])
        at = 3 if len(data) >= 3 else 1
        while at < len(data):
            b = data[at]
            at += 1
            if b == IC and at + 2 <= len(data):
                self.active.cursor = address(data[at], data[at + 1])
                at += 2
            elif b == SBA:
                if at + 2 > len(data):
                    break
                place = address(data[at], data[at + 1])
                at += 2
                begin = end = at
                while end < len(data) and data[end] not in (SBA, EUA, IC):
                    end += 1
                typed, at = ebcdic.decode(data[at:end]).replace("\0", " ").rstrip(WHITE), end
                f = next((f for f in self.fields.values() if f.at <= place < f.end), None)
                if end > begin and f and not f.protected and not f.hidden:
                    f.modified = True
                    if typed:
                        inputs[f.label if f.label and f.label.strip() else f"field_{place}"] = typed
        return AID.get(data[0], "UNKNOWN"), inputs


FIELD = "start: int, length: int, protected: boolean, numeric: boolean, hidden: boolean, value: string"
EVENT = (
    "session_id string, n long, type string, ts_us long, aid string, inputs map<string,string>, rows int, cols int, plain_text string, "
    f"fields array<struct<{FIELD}>>, screen_hash string, screen_name string, session_key string"
)
_FIELDS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("protected", pa.bool_()), ("numeric", pa.bool_()), ("hidden", pa.bool_()), ("value", pa.string())]))
EVENT_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.string(), _FIELDS, pa.string(), pa.string(), pa.string()]


class Session:
    """One session's pairs (``flow_id, n, request, response``) to events; a submit carries the hash and name of the screen it answers."""

    def __init__(self, close_ts: int | None):
        self.screen, self.n, self.close_ts, self.key = Screen(), 0, close_ts, None

    def _event(self, kind: str, ts: int, aid: str | None = None, inputs: dict | None = None, shot: dict | None = None, named: bool = True) -> tuple:
        shot = shot or {"screen_hash": self.screen.active.hash if kind == "USER_SUBMIT" else None, "screen_name": self.screen.name if named else None}
        self.n += 1
        sid = murmur128_hex(self.key.encode())
        return sid, self.n - 1, kind, ts, aid, None if inputs is None else list(inputs.items()), *(shot.get(k) for k in ("rows", "cols", "plain_text", "fields", "screen_hash", "screen_name")), self.key

    def feed(self, row: tuple) -> list[tuple]:
        flow, _, request, response = row
        out = []
        if self.key is None:
            self.key = str(flow)
            out.append(self._event("SESSION_START", response["ts_us"], named=False))
        shot = self.screen.host_write(filter_telnet(response["data"] or b""))
        out.append(self._event("SCREEN_RENDER", response["ts_us"], shot=shot))
        aid, inputs = self.screen.submit(filter_telnet(request["data"] or b""))
        out.append(self._event("USER_SUBMIT", request["ts_us"], aid, inputs))
        return out

    def finish(self) -> list[tuple]:
        return [] if self.close_ts is None else [self._event("SESSION_END", self.close_ts)]


def terminal_events(pairs: DataFrame, close_ts: int | None = None, enabled: bool = True) -> DataFrame:
    """Events of each session (flow): start, then for each pair the screen that the host wrote and what the user sent; an end if ``close_ts`` is given.

    Switched off (``enabled``), there are none.
    """
    if not enabled:
        return pairs.sparkSession.createDataFrame([], EVENT)
    rows = pairs.select("flow_id", "n", F.struct("request.data", "request.ts_us").alias("request"), F.struct("response.data", "response.ts_us").alias("response"))
    return by_flow(rows, "flow_id", ["n"], lambda: Session(close_ts), EVENT, EVENT_KINDS)


def last_screen(events: DataFrame, key: str = "session_id", order: str = "n", kind: str = "type", cols: tuple[str, ...] = ("plain_text", "screen_hash", "screen_name")) -> DataFrame:
    """Submits with the session's latest screen as ``screen``; starts and ends forget it, and submits without one go."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    epoch = events.select("*", F.count(F.when(F.col(kind).isin("SESSION_START", "SESSION_END"), 1)).over(w).alias("_epoch"))
    e = W.partitionBy(key, "_epoch").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = epoch.select("*", F.last(F.when(F.col(kind) == "SCREEN_RENDER", F.struct(*cols)), ignorenulls=True).over(e).alias("screen"))
    return seen.where((F.col(kind) == "USER_SUBMIT") & F.col("screen").isNotNull()).drop("_epoch")


def redact(inputs: Column, labels: str) -> Column:
    """Values whose label matches ``labels`` wholly, all but the last three characters starred, white space kept."""
    return F.transform_values(inputs, lambda k, v: F.when(F.rlike(k, F.lit(rf"\A(?:{labels})\z")), F.regexp_replace(v, r"(?s)\S(?=.{3})", "*")).otherwise(v))


def sampled(renders: DataFrame, rate: float, key: Column) -> DataFrame:
    """A share of rows chosen by a hash (of the key as text), so that it is the same each time; rates outside 0..1 are brought inside, NaN is 0."""
    rate = 0.0 if rate != rate else min(1.0, max(0.0, rate))
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return renders.where(number % 1_000_000 < int(rate * 1_000_000))
