"""The per-flow machines, without Spark."""

import random

from sluice.functions import ebcdic
from sluice.functions.binary import decode_chunked, murmur128_hex, murmur128_of
from sluice.operators.http import HttpFramer
from sluice.operators.reassembly import Reassembler
from sluice.operators.reports import decode_message
from sluice.operators.terminal import EOR, ERASE_WRITE, EUA, IAC, SBA, SF, RecordFramer, Screen, filter_telnet


def run(*segments):
    r = Reassembler()
    return [r.accept(s, d)[0] for s, d in segments]


def test_reassembly_vectors():
    assert run((1000, b"foo"), (1006, b"bar"), (1003, b"baz")) == [b"foo", b"", b"bazbar"]
    assert run((3000, b"hello"), (3003, b"lo world"), (3003, b"lo world!!!"), (3003, b"lo world!!!")) == [b"hello", b" world", b"!!!", b""]
    assert run((0xFFFFFFF0, b"abcd"), (5, b"efg")) == [b"abcd", b""]
    assert run((7, b"")) == [b""]


def test_reassembly_times():
    """What is released has the time of its last piece by sequence, not of the one that closed the gap."""
    timed = lambda *segments: [got for got in (r.accept(*x) for x in segments) if got[0]]
    r = Reassembler()
    assert timed((0, b"ab", 1), (4, b"ef", 200), (2, b"cd", 900)) == [(b"ab", 1), (b"cdef", 200)]
    r = Reassembler()  # of an overlapped piece the tail stays, with its own time
    assert timed((0, b"a", 1), (3, b"defg", 5), (1, b"bcde", 9)) == [(b"a", 1), (b"bcdefg", 5)]
    r = Reassembler()  # one that is covered wholly goes
    assert timed((0, b"a", 1), (3, b"d", 5), (1, b"bcde", 9)) == [(b"a", 1), (b"bcde", 9)]


def test_reassembly_random_orders():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(5, 60)))
        cuts = [(0, rng.randrange(1, len(text) + 1))]
        for _ in range(rng.randrange(30)):
            a = rng.randrange(len(text))
            cuts.append((a, rng.randrange(a + 1, len(text) + 1)))
        rest = [(k, min(len(text), k + 3)) for k in range(0, len(text), 2)]
        rng.shuffle(rest)
        assert b"".join(run(*((a, text[a:b]) for a, b in cuts + rest))) == text


def test_http_framing():
    f = HttpFramer(True)
    assert f.feed(b"POST / HTTP/1.1\r\nContent-Length: 4\r\n\r\nab") == []
    assert f.feed(b"cdGET /x HTTP/1.1\r\n\r\n") == [b"POST / HTTP/1.1\r\nContent-Length: 4\r\n\r\nabcd", b"GET /x HTTP/1.1\r\n\r\n"]
    # What the modelled framing gives; Content-Length goes before the status, the last field counts.
    assert HttpFramer(False).feed(b"HTTP/1.1 304 x\r\nContent-Length: 9\r\n\r\n") == []
    assert HttpFramer(False).feed(b"HTTP/1.1 304 x\r\n\r\nHTTP/1.1 204  \r\n\r\n") == [b"HTTP/1.1 304 x\r\n\r\n", b"HTTP/1.1 204  \r\n\r\n"]
    assert HttpFramer(True).feed(b"POST / HTTP/1.1\r\nContent-Length: 9\r\n content-LENGTH : 2\r\n\r\nabc") == [b"POST / HTTP/1.1\r\nContent-Length: 9\r\n content-LENGTH : 2\r\n\r\nab"]
    for odd in (b"\xb2", b"-1", b"1x", b""):
        assert HttpFramer(True).feed(b"POST / HTTP/1.1\r\nContent-Length: " + odd + b"\r\n\r\n") == [b"POST / HTTP/1.1\r\nContent-Length: " + odd + b"\r\n\r\n"]
    assert len(HttpFramer(True).feed(b"POST / HTTP/1.1\r\nTransfer-Encoding: xchunked\r\n\r\nabc")[0]) == 48
    two = b"POST / HTTP/1.1\r\nTransfer-Encoding: gzip, Chunked\r\nTransfer-Encoding: x\r\n\r\nabc"
    assert HttpFramer(True).feed(two) == [two]
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n"
    assert HttpFramer(False).feed(chunked) == [chunked]
    strict = HttpFramer(False, strict=True)
    assert strict.feed(chunked) == []
    assert strict.feed(b"0\r\n\r\n") == [chunked + b"0\r\n\r\n"]
    rng = random.Random(3)
    text = b"".join(b"POST /%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % (k, n) + b"x" * n for k, n in enumerate(rng.choices(range(40), k=60)))
    for _ in range(20):
        cuts = sorted(rng.sample(range(len(text)), 100))
        f = HttpFramer(True)
        got = [m for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) for m in f.feed(text[a:b])]
        assert b"".join(got) == text and len(got) == 60 and f.held() == 0
    big = HttpFramer(True)
    assert big.feed(b"POST / HTTP/1.1\r\nContent-Length: 40000000\r\n\r\n") == [] and [len(x) for k in range(40000) for x in big.feed(b"y" * 1000)] == [40000000 + len(b"POST / HTTP/1.1\r\nContent-Length: 40000000\r\n\r\n")]
    huge = HttpFramer(True)
    assert huge.feed(b"POST / HTTP/1.1\r\nContent-Length: 99999999999\r\n\r\nab") == []


def test_telnet_records():
    f = RecordFramer()
    assert f.feed(b"ab" + bytes([IAC, IAC, IAC, 0xFB, 25]) + b"c") == []
    assert f.feed(bytes([IAC, 0xFA, 1, 2, IAC, 0xF0, IAC, EOR, IAC, EOR]) + b"d") == [b"ab\xffc"]
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice([1, 2, IAC, IAC, 0xFA, 0xF0, EOR, 0xFB]) for _ in range(40))
        whole, parts = RecordFramer(), RecordFramer()
        assert whole.feed(data) == [m for i in range(0, 40, 7) for m in parts.feed(data[i : i + 7])] and (whole.record, whole.mode) == (parts.record, parts.mode)
    assert filter_telnet(b"x" + bytes([IAC, 0xFD, 1]) + b"y") == b"xy"


def screen():
    s = Screen()
    at = lambda n: bytes([SBA, 0x40 | n >> 6, 0x40 | n & 63])
    write = bytes([ERASE_WRITE, 0x40]) + at(0) + bytes([SF, 0x20]) + ebcdic.encode("SIN:") + at(5) + bytes([SF, 0x40]) + ebcdic.encode(" " * 9) + at(20) + bytes([SF, 0x20]) + ebcdic.encode("YEAR:") + at(26) + bytes([SF, 0x40]) + ebcdic.encode(" " * 4)
    return s, at, s.host_write(write)


def test_screen_and_submit():
    s, at, shot = screen()
    # Attribute bytes are characters of the screen.
    assert shot["plain_text"].split("\n")[0] == "\x80SIN:" + " " * 15 + "\x80YEAR:"
    # NULs stay in values and count in the hash, and only white space is cut from the end.
    blank = lambda fill: Screen().host_write(bytes([ERASE_WRITE, 0x40]) + at(0) + bytes([SF, 0x20]) + ebcdic.encode("A") + fill + ebcdic.encode("B") + at(8) + bytes([SF, 0x40]))
    assert [x["fields"][0]["value"] for x in (blank(b"\0"), blank(b"\x40"))] == ["A\0B", "A B"] and blank(b"\0")["screen_hash"] != blank(b"\x40")["screen_hash"]
    assert [f["protected"] for f in shot["fields"]] == [True, False, True, False]
    assert shot["screen_name"] == "SIN" and len(shot["screen_hash"]) == 32
    aid, inputs = s.submit(bytes([0x7D, 0x40, 0x40]) + at(6) + ebcdic.encode("123456789") + at(27) + ebcdic.encode("2024"))
    assert (aid, inputs) == ("ENTER", {"SIN:": "123456789", "YEAR:": "2024"})
    assert s.submit(bytes([0x7D, 0x40, 0x40]) + at(6) + ebcdic.encode("BOB") + b"\0\0" + bytes([EUA, 0x40, 0x50]))[1] == {"SIN:": "BOB"}
    assert s.submit(bytes([0x7D, 0x40, 0x40]) + at(6) + b"\0\0")[1] == {}
    assert s.submit(bytes([0x7D, 0x40, 0x40]) + at(1) + ebcdic.encode("no"))[1] == {}
    assert s.submit(b"") == ("UNKNOWN", {})


def test_label_of_a_field_in_column_0():
    s = Screen()
    at = lambda n: bytes([SBA, 0x40 | n >> 6, 0x40 | n & 63])
    s.host_write(bytes([ERASE_WRITE, 0x40]) + at(70) + ebcdic.encode("CITY") + at(80) + bytes([SF, 0x40]) + ebcdic.encode("    "))
    assert s.submit(bytes([0x7D, 0x40, 0x40]) + at(81) + ebcdic.encode("X"))[1] == {"CITY": "X"}


def test_structured_field_shape():
    s = Screen()
    s.host_write(bytes([0xF3, 0x00, 0x00, 0x08, 0x02, 0, 0, 12, 40]) + ebcdic.encode("A"))
    assert (s.rows, s.cols) == (12, 40)


def test_partitions_keep_their_screens():
    s = Screen()
    at = lambda n: bytes([SBA, 0x40 | n >> 6, 0x40 | n & 63])
    part = lambda number, body, rows=2, cols=20: bytes([0xF3, 0x00]) + (7 + len(body)).to_bytes(2, "big") + bytes([0x04, number, 0, rows, cols]) + body
    one = s.host_write(part(1, bytes([SF, 0x20]) + ebcdic.encode("ONE")))
    two = s.host_write(part(2, at(0) + bytes([SF, 0x20]) + ebcdic.encode("TWO"), 3, 0))
    assert (one["rows"], one["cols"], one["plain_text"]) == (2, 20, "\x80ONE\n") and (two["rows"], two["cols"]) == (3, 80) and two["plain_text"] == "\x80TWO\n\n"
    again = s.host_write(part(1, b""))
    assert "ONE" in again["plain_text"]  # only the fields go
    assert again["fields"] == [] and s.partitions[2].hash == two["screen_hash"] != one["screen_hash"] and s.partitions[1].hash is None
    wide = s.host_write(part(1, b"", 2, 40))
    assert wide["plain_text"] == "\n" and len(s.partitions) == 3


def test_functions():
    assert murmur128_hex(b"") == "0" * 32
    assert murmur128_hex(b"hello") == "029bbd41b3a7d8cb191dae486a901e5b"
    assert decode_chunked(b"3;x=1\r\nhi!\r\n0\r\n\r\n") == b"hi!"
    assert ebcdic.decode(ebcdic.encode("Az09[]^")) == "Az09[]^" and len(set(ebcdic.TABLE)) == 256


def test_decode_message():
    import gzip

    got = decode_message(b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nhi!\r\n0\r\n\r\n")
    assert got == b"POST / HTTP/1.1\r\nContent-Length: 3\r\n\r\nhi!"
    packed = gzip.compress(b"hello world")
    assert decode_message(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: 9\r\n\r\n" + packed).endswith(b"Content-Length: 11\r\n\r\nhello world")
    assert decode_message(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnope").endswith(b"gzip\r\n\r\nnope")


def test_murmur_of_many_values():
    rng = random.Random(77)
    values = [rng.randbytes(n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 48, 1000, *(rng.randrange(200) for _ in range(100)))]
    assert murmur128_of(values) == [murmur128_hex(v) for v in values]
    assert murmur128_of([]) == [] and murmur128_of([b""]) == [murmur128_hex(b"")]
