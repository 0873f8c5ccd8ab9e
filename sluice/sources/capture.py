"""Capture files as Spark data sources: ``pcap`` frames and ``segbin`` segments, in batch and as streams, and the decoding of frames.

Files are listed on the driver and read in splits of ``splitMiB`` (0: whole files).  A split's first record is found by looking for a place from
which a chain of record headers holds; ``records.py`` says why a payload that holds records doesn't mislead it.  ``arrival`` is the file's number in
name order, shifted, plus the record's place in the file, so it doesn't depend on the splits.  ``filter`` (a capture filter), ``sinceUs`` and
``untilUs`` (times) are decided in the scan, before a row is made.  They are options and not pushed by Spark: its Python sources keep what the first query of
a DataFrame pushed for the next ones (4.1).  Register with ``register(spark)``.
"""

from __future__ import annotations

import ipaddress
import json
import re
import struct
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import ACK, FIN, FRAME, PSH, RST, SEGMENT, SYN
from ._files import listed, locate, put
from .records import MAX_RECORD, PCAP_MAGIC, SEGBIN_MAGIC, Form, form_of

FILE_SHIFT = 40
# Link types.
LINK_TYPES = (1, 113, 276)
# TCP's experimental option, and the identifier in it of ours, which holds ports and a sequence number beyond the header's 16 and 32 bits.
EXPERIMENT, WIDE = 253, b"SLUW"
ROLL_MIB = SPLIT_MIB = 64
READ_AHEAD = 1 << 20
#: Rows and bytes that a batch of a scan holds at most, but for one long record.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: Where streams say which files each of their batches has written.
BATCHES = "_batches"


class _Split(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int, size: int):
        super().__init__((number, start))
        self.number, self.path, self.start, self.end, self.size = number, path, start, end, size


class _Reader(DataSourceReader):
    suffix = ""
    types: dict[str, pa.DataType] = {}

    def __init__(self, options: dict):
        self.path, self.snaplen = options["path"], int(options.get("snaplen", 262144))
        self.split = int(options.get("splitbytes", 0)) or int(options.get("splitmib", SPLIT_MIB)) << 20
        self.longest = int(options.get("maxrecord", MAX_RECORD))
        self.tree = parse_filter(options["filter"]) if options.get("filter") else None
        self.since, self.until = int(options.get("sinceus", -(1 << 63))), int(options.get("untilus", 1 << 63))

    def files(self) -> list[tuple[str, int]]:
        """Names and sizes, in name order; of files that streams write those of complete batches."""
        store, base = locate(self.path)
        counted = written_by_streams(self.path)
        paths = [p for p in listed(self.path, self.suffix) if not p.rsplit("/", 1)[-1].startswith("part-stream-") or p.rsplit("/", 1)[-1] in counted]
        return [(i.path, i.size) for i in store.get_file_info(paths)] if paths else []

    def splits(self, files: list[tuple[str, int]], first: int = 0) -> list[InputPartition]:
        return [_Split(n, path, at, min(size, at + (self.split or size)), size) for n, (path, size) in enumerate(files, first) for at in range(0, max(size, 1), self.split or max(size, 1))]

    def partitions(self) -> list[InputPartition]:
        return self.splits(self.files())

    def read(self, partition: _Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's word for no partitions
            return
        store, _ = locate(self.path)
        names = [f.split()[0] for f in (SEGMENT if "payload" in self.types else FRAME).split(", ")]
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(partition.path) as f:
            form = form_of(f, self.suffix)
            self.check(form)
            for at, head, body in form.records(f, partition.start, partition.end, partition.size, self.longest):
                row = self.row(partition.number << FILE_SHIFT | at, form, head, body)
                if row is not None and self.since <= row[1] < self.until:
                    rows.append(row)
                    held += len(row[-1])
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self._batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names)

    def _batch(self, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, self.types[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def check(self, form: Form) -> None:
        pass

    def row(self, arrival: int, form: Form, head: tuple, body: bytes) -> tuple | None:
        raise NotImplementedError


class PcapReader(_Reader):
    suffix = ".pcap"
    types = {"arrival": pa.int64(), "ts_us": pa.int64(), "data": pa.binary()}

    def check(self, form: Form) -> None:
        if form.link not in LINK_TYPES:
            raise ValueError(f"unsupported link type {form.link}")

    def row(self, arrival: int, form: Form, head: tuple, body: bytes) -> tuple | None:
        if self.tree is not None:
            got = decode_frame(body)
            if got is None or not matches(self.tree, *got[:4]):
                return None
        return arrival, head[0] * 1_000_000 + head[1] // form.ticks, body[: self.snaplen]


class SegbinReader(_Reader):
    suffix = ".segbin"
    types = {"arrival": pa.int64(), "ts_us": pa.int64(), "src_ip": pa.string(), "src_port": pa.int32(), "dst_ip": pa.string(), "dst_port": pa.int32(), "seq": pa.int64(), "flags": pa.int32(), "payload": pa.binary()}

    def row(self, arrival: int, form: Form, head: tuple, body: bytes) -> tuple | None:
        got = _segment(body)
        return None if self.tree is not None and not matches(self.tree, *got[1:5]) else (arrival, *got)


class _Stream(DataSourceStreamReader):
    """New files in name order: files appear whole, under names after those that are there, as the writers of this module see to.

    An offset is the number of files that have been read and the last one's name.  A batch takes all that is new; ``maxBytes`` holds it to so much (one
    file at least), but for the first batch after a start from a checkpoint.
    """

    def __init__(self, reader: _Reader, options: dict):
        self.reader, self.most = reader, int(options.get("maxbytes", 0))
        self.taken: int | None = None

    def initialOffset(self) -> dict:
        self.taken = 0
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:
        files = self.reader.files()
        n = len(files)
        if self.most and self.taken is not None:
            n, size = self.taken, 0
            while n < len(files) and (n == self.taken or size + files[n][1] <= self.most):
                size += files[n][1]
                n += 1
        return {"files": n, "last": files[n - 1][0].rsplit("/", 1)[-1] if n else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self.reader.files()
        for o in (start, end):
            if o["files"] and (len(files) < o["files"] or files[o["files"] - 1][0].rsplit("/", 1)[-1] != o["last"]):
                raise RuntimeError(f"{self.reader.path}: the files up to {o['last']} aren't those that were there; new files need names after the old ones'")
        self.taken = end["files"]
        return self.reader.splits(files[start["files"] : end["files"]], start["files"])

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


def _segment(body: bytes) -> tuple:
    at = 0

    def take(form: str):
        nonlocal at
        (out,) = struct.unpack_from(form, body, at)
        at += struct.calcsize(form)
        return out

    def text() -> str:
        nonlocal at
        n = take(">H")
        at += n
        return body[at - n : at].decode()

    ts = take(">q")
    src, sport, dst, dport, seq, flags, n = text(), take(">i"), text(), take(">i"), take(">q"), take(">i"), take(">i")
    return ts, src, sport, dst, dport, seq, flags, body[at : at + n]


def segment_record(ts: int, src: str, sport: int, dst: str, dport: int, seq: int, flags: int, payload: bytes) -> bytes:
    name = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    body = struct.pack(">q", ts) + name(src) + struct.pack(">i", sport) + name(dst) + struct.pack(">iqii", dport, seq, flags, len(payload)) + payload
    return struct.pack(">i", len(body)) + body


class _Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Each task writes its own files, a new one before a record would exceed ``rollMiB`` (0: never), first under temporary names.

    The commit names the files of the tasks that count; the commit and the abort delete temporary files of all others.
    """

    suffix, head = "", b""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("rollmib", options.get("rollMiB", 0))) << 20
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def records(self, rows) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        return _Done(self.put(rows, f"part-{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}", ".tmp"))

    def put(self, rows, stem: str, ending: str) -> list[str]:
        """Write a task's rows; the names of its files, without the ``ending`` that they have so far."""
        store, base = locate(self.path)
        store.create_dir(base)
        out, files = None, []
        for data in self.records(rows):
            if out is None or (self.roll and out.tell() + len(data) > self.roll):
                if out:
                    out.close()
                files.append(f"{base}/{stem}-{len(files):04d}{self.suffix}")
                out = store.open_output_stream(files[-1] + ending, buffer_size=READ_AHEAD)
                out.write(self.head)
            out.write(data)
        if out:
            out.close()
        return files

    def _clean(self) -> None:
        store, _ = locate(self.path)
        for f in listed(self.path, ".tmp"):
            if f"part-{self.job}-" in f:
                store.delete_file(f)

    def commit(self, messages) -> None:
        store, _ = locate(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.move(f + ".tmp", f)
        self._clean()

    def abort(self, messages) -> None:
        self._clean()


class SegbinWriter(_Writer):
    suffix, head = ".segbin", SEGBIN_MAGIC

    def records(self, rows) -> Iterator[bytes]:
        for r in rows:
            yield segment_record(r["ts_us"], r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["seq"], r["flags"], bytes(r["payload"] or b""))


class PcapWriter(_Writer):
    """Segments as frames; after every ``everyJunk`` of a task's segments (0: never) a frame that is none."""

    suffix, head = ".pcap", struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)

    def __init__(self, options: dict):
        super().__init__(options)
        self.every_junk = int(options.get("everyjunk", options.get("everyJunk", 0)))

    def records(self, rows) -> Iterator[bytes]:
        for n, r in enumerate(rows):
            data = [encode_frame(r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["seq"], r["flags"], bytes(r["payload"] or b""))]
            data += [b"no frame"] if self.every_junk and n % self.every_junk == 0 else []
            for f in data:
                yield struct.pack("<IIII", *divmod(r["ts_us"], 1_000_000), len(f), len(f)) + f


class _StreamWriter(DataSourceStreamWriter):
    """A stream's batches as files whose names tell stream, batch and task; they count once the batch has its list, which is written last and at once.

    A batch that comes again after its list was written is dropped; one that failed before has left files that no list names, and readers pass over them.
    ``stream`` (an option) tells streams into one folder apart.
    """

    def __init__(self, writer: _Writer, options: dict):
        self.writer, self.stream = writer, options.get("stream", "0")
        self.run = f"{time.time_ns():020d}"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        return _Done(self.writer.put(rows, f"part-stream-{self.stream}-{self.run}-{context.partitionId():05d}-{context.taskAttemptId()}", ""))

    def commit(self, messages, batchId: int) -> None:
        store, base = locate(self.writer.path)
        name = f"{base}/{BATCHES}/{self.stream}-{batchId:012d}.json"
        files = [f.rsplit("/", 1)[-1] for m in messages if m for f in m.files]
        if store.get_file_info(name).is_file:
            for f in files:
                store.delete_file(f"{base}/{f}")
            return
        store.create_dir(f"{base}/{BATCHES}")
        put(store, name, json.dumps(files).encode())

    def abort(self, messages, batchId: int) -> None:
        store, base = locate(self.writer.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f)


def written_by_streams(path: str) -> set[str]:
    """The files of all complete batches of streams into a folder."""
    store, _ = locate(path)
    out: set[str] = set()
    for name in listed(f"{path}/{BATCHES}", ".json"):
        with store.open_input_stream(name) as f:
            out.update(json.loads(f.read()))
    return out


class _Source(DataSource):
    read_by: type[_Reader]
    written_by: type[_Writer]

    def reader(self, schema) -> DataSourceReader:
        return self.read_by(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return self.written_by(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.read_by(self.options), self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.written_by(self.options), self.options)


class PcapSource(_Source):
    """Reads frames and writes segments as frames."""

    read_by, written_by = PcapReader, PcapWriter

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAME


class SegbinSource(_Source):
    read_by, written_by = SegbinReader, SegbinWriter

    @classmethod
    def name(cls) -> str:
        return "segbin"

    def schema(self) -> str:
        return SEGMENT


def write_frames(segments: DataFrame, folder: str, every_junk: int = 0, roll_mib: int = ROLL_MIB) -> None:
    """Segments as Ethernet frames of IPv4 and TCP in capture files, of ``roll_mib`` at most; after every ``every_junk`` of a partition a frame that is none."""
    register(segments.sparkSession)
    segments.write.format("pcap").mode("append").option("path", folder).option("everyJunk", every_junk).option("rollMiB", roll_mib).save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
    spark.dataSource.register(SegbinSource)


@lru_cache(1 << 16)
def _packed(address: str) -> bytes:
    return ipaddress.IPv4Address(address).packed


@lru_cache(1 << 16)
def _ipv4(raw: bytes) -> str:
    return str(ipaddress.IPv4Address(raw))


def encode_frame(src: str, sport: int, dst: str, dport: int, seq: int, flags: int, payload: bytes) -> bytes:
    """Ethernet, IPv4 and TCP; ports or a sequence number too large for the header go whole into an option, and their low bits into the header."""
    # TCP's bits of FIN, SYN, RST, PSH, ACK; option 1 pads to words of four bytes.
    wire = (flags & FIN and 1) | (flags & SYN and 2) | (flags & RST and 4) | (flags & PSH and 8) | (flags & ACK and 16)
    narrow = (sport & 0xFFFF, dport & 0xFFFF, seq & 0xFFFFFFFF)
    options = b""
    if narrow != (sport, dport, seq):
        options = struct.pack(">BB4siiqBB", EXPERIMENT, 22, WIDE, sport, dport, seq, 1, 1)
    tcp = struct.pack(">HHIIBBHHH", *narrow, 0, 5 + len(options) // 4 << 4, wire, 0, 0, 0) + options + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + _packed(src) + _packed(dst)
    return bytes(12) + b"\x08\x00" + ip + tcp


def _wide(options: bytes) -> tuple[int, int, int] | None:
    """Ports and sequence number of our own option, if it is there."""
    at = 0
    while at < len(options) and options[at] != 0:
        size = 1 if options[at] == 1 else options[at + 1] if at + 1 < len(options) else 0
        if size < 1 or at + size > len(options):
            return None
        if size == 22 and options[at] == EXPERIMENT and options[at + 2 : at + 6] == WIDE:
            return struct.unpack_from(">iiq", options, at + 6)
        at += size
    return None


def _ipv6(raw: bytes) -> str:
    """Eight groups in hex without leading zeros, never shortened."""
    return ":".join(f"{int.from_bytes(raw[i : i + 2], 'big'):x}" for i in range(0, 16, 2))


def decode_frame(data: bytes, wide: bool = False) -> tuple | None:
    """Ethernet, one VLAN tag at most, IPv4 or IPv6 without extensions, TCP: the segment's columns; None for all else or short frames.

    A length in the IP header that leaves no room for TCP, such as 0 where the card cuts segments, gives an empty payload.  ``wide`` reads our own TCP option.
    """
    if len(data) < 14:
        return None
    kind, at = int.from_bytes(data[12:14], "big"), 14
    if kind in (0x8100, 0x88A8):
        if len(data) < 18:
            return None
        kind, at = int.from_bytes(data[16:18], "big"), 18
    if kind == 0x0800:
        if len(data) < at + 20 or data[at] >> 4 != 4 or data[at + 9] != 6:
            return None
        head, whole = (data[at] & 15) * 4, int.from_bytes(data[at + 2 : at + 4], "big")
        src, dst = (_ipv4(bytes(data[at + k : at + k + 4])) for k in (12, 16))
    elif kind == 0x86DD:
        if len(data) < at + 40 or data[at] >> 4 != 6 or data[at + 6] != 6:
            return None
        head, whole = 40, 40 + int.from_bytes(data[at + 4 : at + 6], "big")
        src, dst = _ipv6(data[at + 8 : at + 24]), _ipv6(data[at + 24 : at + 40])
    else:
        return None
    tcp = at + head
    if head < 20 or len(data) < tcp + 20:
        return None
    sport, dport, seq = struct.unpack_from(">HHI", data, tcp)
    size = (data[tcp + 12] >> 4) * 4
    if size < 20 or len(data) < tcp + size:
        return None
    if wide and size > 20 and (own := _wide(data[tcp + 20 : tcp + size])):
        sport, dport, seq = own
    wire = data[tcp + 13]
    flags = (wire & 1 and FIN) | (wire & 2 and SYN) | (wire & 4 and RST) | (wire & 8 and PSH) | (wire & 16 and ACK)
    return src, sport, dst, dport, seq, flags, data[tcp + size : max(tcp + size, min(len(data), at + whole))]


_DECODED = "src_ip string, src_port int, dst_ip string, dst_port int, seq long, flags int, payload binary"


def decode_frames(frames: DataFrame, wide: bool = False) -> DataFrame:
    """Segments of the frames that decode.

    ``wide`` takes ports and sequence numbers from the option that ``encode_frame`` writes; off for captures of others, as whoever sends a frame can set it.
    """

    @F.pandas_udf(_DECODED)
    def decode(data: pd.Series) -> pd.DataFrame:
        rows = [decode_frame(bytes(d), wide) if d is not None else None for d in data]
        return pd.DataFrame([r or (None,) * 7 for r in rows], columns=[c.split()[0] for c in _DECODED.split(", ")])

    return frames.select("arrival", "ts_us", decode("data").alias("s")).where("s.src_ip IS NOT NULL").select("arrival", "ts_us", "s.*")


_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.:]+)")


# Filters that need no opt-in, and characters that no filter may hold.
DEFAULT_FILTERS = ("tcp", "tcp and (port 23 or port 992)")
FORBIDDEN = ";`"


def allowed_filter(expression: str, custom: bool = False) -> str:
    """The filter, if it is a default or ``custom`` filters are opted into and it holds nothing forbidden."""
    text = expression.strip()
    if text in DEFAULT_FILTERS:
        return text
    if not custom:
        raise ValueError("a filter of one's own needs the opt-in")
    if any(c in FORBIDDEN for c in text):
        raise ValueError("a filter holds a forbidden character")
    return text


def parse_filter(expression: str) -> tuple:
    """A capture filter as a tree: tcp, [src|dst] port N, [src|dst] host A, and, or, not, parentheses."""
    if not expression.strip() or len(expression) > 1024 or not expression.isprintable() or not expression.isascii():
        raise ValueError("a filter has 1 to 1024 printable ASCII characters")
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"unexpected character in filter: {expression[at]}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def peek() -> str:
        return tokens[-1].lower() if tokens else ""

    def either() -> tuple:
        out = both()
        while peek() == "or":
            tokens.pop()
            out = "or", out, both()
        return out

    def both() -> tuple:
        out = one()
        while peek() == "and":
            tokens.pop()
            out = "and", out, one()
        return out

    def one() -> tuple:
        if not tokens:
            raise ValueError("filter ends early")
        word = tokens.pop().lower()
        if word == "not":
            return "not", one()
        if word == "(":
            out = either()
            if not tokens or tokens.pop() != ")":
                raise ValueError("missing )")
            return out
        if word == "tcp":
            if peek() in ("port", "src", "dst", "host"):
                return one()
            return ("all",)
        sides = ("src", "dst")
        if word in sides:
            sides, word = (word,), tokens.pop().lower() if tokens else ""
        if word not in ("port", "host") or not tokens:
            raise ValueError(f"unsupported filter word: {word}")
        want = tokens.pop()
        return word, sides, int(want) if word == "port" else want

    out = either()
    if tokens:
        raise ValueError(f"unexpected filter word: {tokens[-1]}")
    return out


def bpf(expression: str) -> Column:
    """A capture filter over segments."""

    def column(tree: tuple) -> Column:
        if tree[0] == "all":
            return F.lit(True)
        if tree[0] == "not":
            return ~column(tree[1])
        if tree[0] in ("and", "or"):
            a, b = column(tree[1]), column(tree[2])
            return a & b if tree[0] == "and" else a | b
        kind, sides, want = tree
        tests = [F.col(f"{s}_{'port' if kind == 'port' else 'ip'}") == want for s in sides]
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    return column(parse_filter(expression))


def matches(tree: tuple, src_ip: str, src_port: int, dst_ip: str, dst_port: int) -> bool:
    """The same on one segment's ends."""
    if tree[0] == "all":
        return True
    if tree[0] == "not":
        return not matches(tree[1], src_ip, src_port, dst_ip, dst_port)
    if tree[0] in ("and", "or"):
        first = matches(tree[1], src_ip, src_port, dst_ip, dst_port)
        return first if first == (tree[0] == "or") else matches(tree[2], src_ip, src_port, dst_ip, dst_port)
    kind, sides, want = tree
    ends = {"src": (src_ip, src_port), "dst": (dst_ip, dst_port)}
    return any(ends[s][kind == "port"] == want for s in sides)
