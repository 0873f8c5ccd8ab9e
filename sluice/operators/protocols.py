"""Protocols as the engine takes them: ports, signature, framing and pairing; more can be given beside these two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .detect import PORTS, http_begins, telnet_marks
from .http import HttpFramer
from .terminal import RecordFramer


@dataclass(frozen=True)
class Protocol:
    """``signature`` looks at the first bytes of a flow, ``framer`` makes what cuts one direction (True: the client's) into messages.

    A framer has ``feed``, which takes bytes and gives whole messages, and ``held``, the bytes that wait; its state must pickle.
    With ``drops_orphans`` a response goes if no request waits, without it waits for one.
    """

    name: str
    ports: tuple[int, ...]
    signature: Callable[[bytes], bool]
    framer: Callable[[bool], object]
    drops_orphans: bool = True


def _records(from_client: bool) -> RecordFramer:
    return RecordFramer()


HTTP = Protocol("HTTP", PORTS["HTTP"], http_begins, HttpFramer)
TN3270 = Protocol("TN3270", PORTS["TN3270"], telnet_marks, _records, drops_orphans=False)
KNOWN = (HTTP, TN3270)


def recognise(port: int, preface: bytes, protocols: tuple[Protocol, ...] = KNOWN) -> Protocol | None:
    """The one protocol that claims the server's port; where none or several do, the one whose signature the preface has."""
    claims = [p for p in protocols if port in p.ports]
    if len(claims) == 1:
        return claims[0]
    found = [p for p in protocols if p.signature(preface)]
    return found[0] if len(found) == 1 else None
