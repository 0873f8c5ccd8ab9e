"""From raw segments to pairs of messages in one pass over each conversation: the machine of batch and of streaming.

A conversation's segments in arrival order are oriented (the client is the sender of the last SYN without ACK, else
the first sender), reassembled by direction, recognised by port or first bytes, framed and paired.  A FIN or RST ends
the flow after its own segment.  Slices that come before the protocol is known count for recognition only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import ACK, FIN, RST, SYN
from ._stream import by_flow
from .detect import PREFACE_BYTES
from .flows import conversation
from .protocols import KNOWN, Protocol, recognise
from .reassembly import Reassembler

END = "struct<ip: string, port: int>"
SIDE = "struct<data: binary, ts_us: bigint>"
PAIR = f"conv string, flow_id string, protocol string, n bigint, request {SIDE}, response {SIDE}, client {END}, server {END}, dropped_bytes bigint"
COLUMNS = ("conv", "arrival", "src_ip", "src_port", "dst_ip", "dst_port", "seq", "flags", "payload", "ts_us")
_SIDE = pa.struct([("data", pa.binary()), ("ts_us", pa.int64())])
_END = pa.struct([("ip", pa.string()), ("port", pa.int32())])
PAIR_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), _SIDE, _SIDE, _END, _END, pa.int64()]


@dataclass
class Flow:
    """One incarnation of a conversation with one end as the client."""

    client: tuple[str, int]
    server: tuple[str, int]
    enabled: tuple[str, ...]
    protocols: tuple[Protocol, ...]
    protocol: Protocol | None = None
    preface: bytes = b""
    n: int = 0
    streams: dict[bool, Reassembler] = field(default_factory=dict)
    framers: dict = field(default_factory=dict)
    waiting: dict[bool, list[tuple[bytes, int]]] = field(default_factory=lambda: {True: [], False: []})

    def feed(self, from_client: bool, seq: int, payload: bytes, ts_us: int) -> list[tuple]:
        """``protocol, n, request, its time, response, its time`` of the pairs that the segment completes."""
        got, ts_us = self.streams.setdefault(from_client, Reassembler()).accept(seq, payload, ts_us)
        if not got:
            return []
        if self.protocol is None:
            self.preface += got[: PREFACE_BYTES - len(self.preface)]
            found = recognise(self.server[1], self.preface, self.protocols)
            if found is None:
                return []
            self.protocol, self.preface = found, b""
        if self.protocol.name not in self.enabled:
            return []
        if from_client not in self.framers:
            self.framers[from_client] = self.protocol.framer(from_client)
        out = []
        for message in self.framers[from_client].feed(got):
            if self.protocol.drops_orphans and not from_client and not self.waiting[True]:
                continue
            self.waiting[from_client].append((message, ts_us))
            if self.waiting[True] and self.waiting[False]:
                self.n += 1
                out.append((self.protocol.name, self.n, *self.waiting[True].pop(0), *self.waiting[False].pop(0)))
        return out

    def held(self) -> int:
        """Bytes that wait for a gap to close, for the rest of a message or for the other side."""
        return sum(s.held() for s in self.streams.values()) + sum(f.held() for f in self.framers.values()) + sum(len(m) for w in self.waiting.values() for m, _ in w)


class Conversation:
    """All flows between two ends; ``feed`` takes a row of ``COLUMNS`` and gives rows of ``PAIR``.

    A flow that ends while bytes wait gives a row without a pair, whose ``dropped_bytes`` counts them.
    """

    def __init__(self, enabled: tuple[str, ...] | None = None, protocols: tuple[Protocol, ...] = KNOWN):
        self.protocols = protocols
        self.enabled = tuple(p.name for p in protocols) if enabled is None else enabled
        self.client: tuple[str, int] | None = None
        self.closed: dict[tuple[str, int], int] = {}
        self.flows: dict[tuple[str, int], Flow] = {}
        self.conv = None

    def _row(self, flow: Flow, protocol, n, request, response, dropped: int) -> tuple:
        end = lambda e: {"ip": e[0], "port": e[1]}
        flow_id = f"{self.conv}#{flow.client[0]}:{flow.client[1]}#{self.closed.get(flow.client, 0)}"
        return self.conv, flow_id, protocol, n, request, response, end(flow.client), end(flow.server), dropped

    def feed(self, row: tuple) -> list[tuple]:
        self.conv, _, src_ip, src_port, dst_ip, dst_port, seq, flags, payload, ts_us = row
        src, dst, flags = (src_ip, src_port), (dst_ip, dst_port), flags or 0
        if self.client is None or (flags & SYN and not flags & ACK):
            self.client = src
        from_client = src == self.client
        if self.client not in self.flows:
            self.flows[self.client] = Flow(self.client, dst if from_client else src, self.enabled, self.protocols)
        flow = self.flows[self.client]
        out = []
        for protocol, n, request, request_ts, response, response_ts in flow.feed(from_client, seq, bytes(payload or b""), ts_us):
            out.append(self._row(flow, protocol, n, {"data": request, "ts_us": request_ts}, {"data": response, "ts_us": response_ts}, 0))
        if flags & (FIN | RST):
            if flow.held():
                out.append(self._row(flow, flow.protocol and flow.protocol.name, None, None, None, flow.held()))
            del self.flows[self.client]
            self.closed[self.client] = self.closed.get(self.client, 0) + 1
            self.client = None
        return out

    def held(self) -> int:
        return sum(f.held() for f in self.flows.values())

    def finish(self) -> list[tuple]:
        return []


def segments_to_pairs(segments: DataFrame, enabled: tuple[str, ...] | None = None, protocols: tuple[Protocol, ...] = KNOWN) -> DataFrame:
    """Pairs of all flows of ``segments``, with both ends: one shuffle by conversation, and a sort that spills. Rows without a pair count dropped bytes.

    ``enabled`` names the protocols that are paired, all by default.
    """
    return by_flow(conversation(segments).select(*COLUMNS), "conv", ["arrival"], lambda: Conversation(enabled, protocols), PAIR, PAIR_KINDS)
