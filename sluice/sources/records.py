"""Records of capture files from any place on: their headers, and where the first record of a split is.

A split that doesn't begin its file looks back as far as the longest record, and takes the first place from which headers hold
each other up, one after the other, to beyond the split's beginning and for some records more.  Bytes of a payload may look like a record, or like many:
such a chain begins inside a payload and ends with it, so it either breaks, and the next place is tried, or goes on with the file's own next record,
and from there on is the file's own chain.  Only bytes that lead past that record on purpose could mislead.  So each split, when it comes
to its end, looks from there as its neighbour does; if both don't agree, the scan fails and asks for whole files.
From the first split on, which needs no search, all splits are right then.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Pcap magic numbers with byte order and ticks a microsecond, segment file magic.
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SEGBIN_MAGIC = b"SGB1"
#: The longest record that a search looks back for, the longest text of an address, records that have to follow a split's beginning.
MAX_RECORD, ADDRESS, CHAIN = 1 << 20, 45, 4
CHUNK = 1 << 20


@dataclass(frozen=True)
class Form:
    """``first``: the first record's place; ``head``: bytes of a record's header."""

    first: int
    head: int

    def header(self, data: bytes, at: int) -> tuple:
        """A header's fields, the body's size last."""
        raise NotImplementedError

    def plausible(self, data: bytes, at: int, longest: int) -> int:
        """The size of the record at a place, 0 if none can begin there; bytes of its body that aren't in ``data`` go unchecked."""
        raise NotImplementedError

    def follow(self, data: bytes, at: int, until: int, size: int, longest: int) -> int:
        """The first place not before ``until`` on the chain from ``at``, -1 if the chain breaks within ``CHAIN`` records of it; places are those in ``data``, whose file ends at ``size``."""
        found, n = -1, 0
        while at < size:
            if at >= until:
                found = at if found < 0 else found
                if n >= CHAIN:
                    return found
                n += 1
            if at + self.head > len(data):
                return found if n > 1 or len(data) < size else -1
            step = self.plausible(data, at, longest)
            if not step:
                return -1
            at += step
        if at > size:  # the last record is cut
            return found if n > 1 else -1
        return found if found >= 0 else size

    def sync(self, f, start: int, size: int, longest: int) -> int:
        """The first record at ``start`` or after it; the file's end if there is none."""
        if start <= self.first:
            return self.first
        low = max(self.first, start - longest)
        data = f.read_at(min(size, start + 2 * longest) - low, low)
        for at in range(len(data)):
            if self.plausible(data, at, longest) and (found := self.follow(data, at, start - low, size - low, longest)) >= 0:
                return low + found
        return size

    def records(self, f, start: int, end: int, size: int, longest: int) -> Iterator[tuple[int, tuple, bytes]]:
        """Place, header and body of the records that begin in a split."""
        at = self.sync(f, start, size, longest)
        base, data = at, b""
        while at < end:
            if at + self.head - base > len(data):
                base, data = at, f.read_at(min(max(CHUNK, self.head), size - at), at)
                if len(data) < self.head:
                    self.short(data)
                    return
            head = self.header(data, at - base)
            body = at + self.head
            if body + head[-1] - base > len(data):
                base, data = at, f.read_at(min(max(CHUNK, self.head + head[-1]), size - at), at)
            got = data[body - base : body - base + head[-1]]
            if len(got) < head[-1]:
                self.cut()
            yield at, head, got
            at = body + head[-1]
        if end < size and at != self.sync(f, end, size, longest):
            raise ValueError(f"records at {end} don't hold together with those before; read this file whole (splitMiB 0)")

    def short(self, rest: bytes) -> None:
        """Bytes too few for a header end a file."""

    def cut(self) -> None:
        """A body that ends with the file is taken as it is."""


@dataclass(frozen=True)
class Pcap(Form):
    order: str
    ticks: int
    link: int

    def header(self, data: bytes, at: int) -> tuple:
        sec, frac, size, whole = struct.unpack_from(self.order + "IIII", data, at)
        return sec, frac, whole, size

    def plausible(self, data: bytes, at: int, longest: int) -> int:
        if at + 16 > len(data):
            return 0
        _, frac, whole, size = self.header(data, at)
        return 16 + size if 0 < size <= whole <= 1 << 24 and size <= longest and frac < 1_000_000 * self.ticks else 0


@dataclass(frozen=True)
class Segbin(Form):
    def header(self, data: bytes, at: int) -> tuple:
        (size,) = struct.unpack_from(">i", data, at)
        if size <= 0:
            raise ValueError("bad record length")
        return (size,)

    def plausible(self, data: bytes, at: int, longest: int) -> int:
        """A record names its length twice: before all, and by the lengths of its addresses and payload."""
        if at + 4 > len(data):
            return 0
        (size,) = struct.unpack_from(">i", data, at)
        if not 36 <= size <= longest:
            return 0
        source = at + 12
        if source + 2 > len(data):
            return 4 + size
        (n,) = struct.unpack_from(">H", data, source)
        target = source + 2 + n + 4
        if n > ADDRESS:
            return 0
        if target + 2 > len(data):
            return 4 + size
        (m,) = struct.unpack_from(">H", data, target)
        length = target + 2 + m + 16
        if m > ADDRESS:
            return 0
        if length + 4 > len(data):
            return 4 + size
        (payload,) = struct.unpack_from(">i", data, length)
        return 4 + size if payload >= 0 and length + 4 + payload == at + 4 + size else 0

    def cut(self) -> None:
        raise ValueError("bad record length")


def form_of(f, suffix: str) -> Form:
    """What a file's first bytes say of its records."""
    if suffix == ".segbin":
        if f.read_at(4, 0) != SEGBIN_MAGIC:
            raise ValueError("not a segment file")
        return Segbin(4, 4)
    head = f.read_at(24, 0)
    if len(head) < 24 or head[:4] not in PCAP_MAGIC:
        raise ValueError("not a pcap file")
    order, ticks = PCAP_MAGIC[head[:4]]
    return Pcap(24, 16, order, ticks, struct.unpack_from(order + "I", head, 20)[0])
