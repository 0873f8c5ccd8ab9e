"""Scalar functions over bytes and text that reports, telnet screens and sinks need."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = (1 << 64) - 1


def hex_preview(data: Column, limit: int = 16) -> Column:
    """Lower-case hex of the first bytes, with dots where more follow."""
    return F.concat(F.lower(F.hex(F.substring(data, 1, limit))), F.when(F.octet_length(data) > limit, "...").otherwise(""))


def hex_dump(data: Column, width: int = 16) -> Column:
    """A line for each ``width`` bytes, each ended by a line feed: offset, bytes in hex, printable characters between bars."""
    count = F.greatest(F.lit(0), ((F.octet_length(data) - 1) / width).cast("int"))

    def line(k: Column) -> Column:
        part = F.substring(data, k * width + 1, F.lit(width))
        offset = F.lower(F.hex(k * width))
        spaced = F.rpad(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "), 3 * width, " ")
        return F.concat(F.lpad(offset, F.greatest(F.length(offset), F.lit(4)), F.lit("0")), F.lit(": "), spaced, F.lit(" |"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", "."), F.lit("|\n"))

    return F.when(F.octet_length(data) > 0, F.array_join(F.transform(F.sequence(F.lit(0), count), line), "")).otherwise("")


def printable_ratio(data: Column) -> Column:
    """Share of bytes that are printable ASCII, tab, line feed or carriage return; 1 for no bytes."""
    n = F.octet_length(data)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e\t\r\n]", "")) / n)


def likely_text(data: Column) -> Column:
    return printable_ratio(data) >= 0.7


def safe_name(name: Column) -> Column:
    """The name with every other character as an underscore; ``unknown`` for none or a blank one."""
    return F.when(F.coalesce(F.trim(F.regexp_replace(name, r"\s", " ")), F.lit("")) == "", "unknown").otherwise(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))


def plain_base64(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def clamp_utf8(text: Column, most: int) -> Column:
    """The text cut to ``most`` bytes of UTF-8 at the end of a whole character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    cut = F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"))


def decode_chunked(data: bytes) -> bytes:
    """The body of chunks; extensions and trailers are skipped, a short chunk is an error."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size expected")
        size = int(data[at:line].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        if line + 2 + size > len(data):
            raise ValueError("short chunk")
        out.append(data[line + 2 : line + 2 + size])
        at = line + 4 + size


def decode_body(data: bytes, encoding: str) -> bytes:
    """gzip or deflate undone; what can't be decoded stays."""
    try:
        if encoding == "gzip":
            return gzip.decompress(data)
        if encoding == "deflate":
            return zlib.decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    return data


# The two multipliers of the published hash's final mixing.
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & _M


def _fmix(k: int) -> int:
    k = ((k ^ k >> 33) * 0xFF51AFD7ED558CCD) & _M
    k = ((k ^ k >> 33) * 0xC4CEB9FE1A85EC53) & _M
    return k ^ k >> 33


def murmur128_hex(data: bytes, seed: int = 0) -> str:
    """MurmurHash3 x64 128 of ``data``, its two halves as little-endian bytes in hex."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    tail = data[whole:].ljust(16, b"\0")
    for at in range(0, whole, 16):
        k1, k2 = struct.unpack_from("<QQ", data, at)
        h1 ^= _rotl(k1 * c1 & _M, 31) * c2 & _M
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 ^= _rotl(k2 * c2 & _M, 33) * c1 & _M
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & _M
    k1, k2 = struct.unpack("<QQ", tail)
    h2 ^= _rotl(k2 * c2 & _M, 33) * c1 & _M
    h1 ^= _rotl(k1 * c1 & _M, 31) * c2 & _M
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    return struct.pack("<QQ", h1, h2).hex()


def _vector(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


def murmur128_of(values: list[bytes]) -> list[str]:
    """``murmur128_hex`` of many values at once: step k takes 16 bytes of all values that are so long."""
    u = np.uint64
    rot = lambda x, r: x << u(r) | x >> u(64 - r)
    first = lambda k: rot(k * u(0x87C37B91114253D5), 31) * u(0x4CF5AD432745937F)
    second = lambda k: rot(k * u(0x4CF5AD432745937F), 33) * u(0x87C37B91114253D5)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    words = np.frombuffer(b"".join(v.ljust(len(v) // 16 * 16 + 16, b"\0") for v in values), dtype="<u8").reshape(-1, 2)
    begins = np.concatenate(([0], np.cumsum(lengths // 16 + 1)))[:-1]
    h1, h2 = np.zeros((2, len(values)), dtype=np.uint64)
    for k in range(int(lengths.max(initial=0)) // 16):
        on = np.flatnonzero(lengths // 16 > k)
        k1, k2 = words[begins[on] + k].T
        x = rot(h1[on] ^ first(k1), 27) + h2[on]
        h1[on] = x * u(5) + u(0x52DCE729)
        y = rot(h2[on] ^ second(k2), 31) + h1[on]
        h2[on] = y * u(5) + u(0x38495AB5)
    if len(values):
        k1, k2 = words[begins + lengths // 16].T
        h2, h1 = h2 ^ second(k2), h1 ^ first(k1)
    size = lengths.astype(np.uint64)
    h1, h2 = h1 ^ size, h2 ^ size
    h1 = h1 + h2
    h2 = h2 + h1
    for _ in range(2):
        h1, h2 = ((h ^ h >> u(33)) * u(c) for h, c in ((h1, _MIX[_]), (h2, _MIX[_])))
    h1, h2 = h1 ^ h1 >> u(33), h2 ^ h2 >> u(33)
    h1 = h1 + h2
    h2 = h2 + h1
    return [raw.hex() for raw in (np.stack((h1, h2), axis=1).astype("<u8").view("V16").ravel().tolist() if len(values) else [])]


def murmur128(data: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        there = values.notna()
        out = pd.Series([None] * len(values), dtype=object, index=values.index)
        out[there] = murmur128_of([bytes(v) for v in values[there]])
        return out

    return run(data)


def strict_variant(text: Column) -> Column:
    """The text's value if it is one JSON document and nothing more (blank counts as an empty object), else null.

    Spark's parser leaves what follows a value alone.  Here the text is parsed as the element of an array and as the member of an object: what
    follows the value would have to be a comma, then another element for the one and a name with a colon for the other, which can't both be.
    """
    own = F.when(F.rlike(text, F.lit(r"\A\s*\z")), "{}").otherwise(text)
    member = F.try_parse_json(F.concat(F.lit('{"a":'), own, F.lit("}")))
    return F.when(member.isNotNull(), F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), own, F.lit("]"))), "$[0]", "variant"))


def dechunked(data: Column) -> Column:
    """Chunked bodies decoded; malformed ones stay."""

    def one(v) -> bytes:
        try:
            return decode_chunked(bytes(v))
        except ValueError:
            return bytes(v)

    return _vector(one, "binary")(data)
