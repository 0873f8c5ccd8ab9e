"""HTTP: framing of messages from byte slices, and parsing of requests and responses into columns."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import decodes_all_charsets
from ._stream import by_flow

END_OF_HEAD = b"\r\n\r\n"
MESSAGE = "flow_id string, ord long, protocol string, type string, data binary, ts_us long"


_CHUNKED = re.compile(rb"(?:^|[, \t])chunked(?:$|[, \t])", re.IGNORECASE)
_STATUS = re.compile(rb"[^ ]* *([0-9]{3})")
_MOST = 2**31 - 1


class HttpFramer:
    """One direction of a flow: whole messages out of a stream of slices.

    A chunked body takes whatever is buffered when its head is complete; ``strict`` waits for the last chunk instead.
    Else the last Content-Length decides, 0 if it is no number.  Without one a request has no body, nor has a response of
    status 1xx, 204 or 304; another response takes what is buffered.  Bytes are looked at once: where the head's
    end was searched and how long a message must get are remembered, and slices that only fill a body are kept apart.
    """

    def __init__(self, from_client: bool, strict: bool = False, buffered: bytes = b""):
        self.from_client, self.strict = from_client, strict
        self.pieces, self.size = [buffered] if buffered else [], len(buffered)
        self.searched = self.needed = 0

    def held(self) -> int:
        return self.size

    def feed(self, data: bytes) -> list[bytes]:
        self.pieces.append(data)
        self.size += len(data)
        out = []
        while self.size and self.size >= self.needed:
            whole = b"".join(self.pieces)
            self.pieces = [whole]
            at = whole.find(END_OF_HEAD, max(0, self.searched - 3))
            if at < 0:
                self.searched = len(whole)
                break
            head = at + len(END_OF_HEAD)
            self.searched = at
            body = self._body(whole[:head], whole, head)
            if body is None:
                break
            if head + body > len(whole):
                self.needed = head + body
                break
            out.append(whole[: head + body])
            rest = whole[head + body :]
            self.pieces, self.size, self.searched, self.needed = [rest] if rest else [], len(rest), 0, 0
        return out

    def _body(self, head: bytes, whole: bytes, at: int) -> int | None:
        length, chunked, lines = None, False, head.split(b"\n")
        for line in lines:
            name, colon, value = line.removesuffix(b"\r").partition(b":")
            if colon and name:
                name, value = name.strip(b" \t").lower(), value.strip(b" \t")
                if name == b"content-length":
                    digits = value.replace(b" ", b"").replace(b"\t", b"")
                    length = min(_MOST, int(digits)) if digits and not digits.strip(b"0123456789") else 0
                elif name == b"transfer-encoding":
                    chunked = chunked or _CHUNKED.search(value) is not None
        if chunked:
            return self._chunks(whole[at:]) if self.strict else len(whole) - at
        if length is not None:
            return length
        status = None if self.from_client else _STATUS.match(lines[0].removesuffix(b"\r"))
        if status and (status[1].startswith(b"1") or status[1] in (b"204", b"304")):
            return 0
        return 0 if self.from_client else len(whole) - at

    @staticmethod
    def _chunks(rest: bytes) -> int | None:
        at = 0
        while (line := rest.find(b"\r\n", at)) >= 0:
            try:
                size = int(rest[at:line].split(b";")[0].strip() or b"0", 16)
            except ValueError:
                return len(rest)
            at = line + 2
            if not size:
                end = rest.find(b"\r\n", at)
                while end > at:
                    at, end = end + 2, rest.find(b"\r\n", end + 2)
                return end + 2 if end >= 0 else None
            at += size + 2
            if at > len(rest):
                return None
        return None


MESSAGE_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()]


class Framing:
    """Both directions of a flow, each through a framer of its own; rows are ``flow_id, arrival, from_client, data, ts_us``."""

    def __init__(self, protocol: str, framer):
        self.protocol, self.framer, self.sides, self.n = protocol, framer, {}, 0

    def feed(self, row: tuple) -> list[tuple]:
        flow, _, from_client, data, ts_us = row
        side = bool(from_client)
        if side not in self.sides:
            self.sides[side] = self.framer(side)
        out = []
        for message in self.sides[side].feed(data or b""):
            out.append((flow, self.n, self.protocol, "REQUEST" if side else "RESPONSE", message, ts_us))
            self.n += 1
        return out

    def finish(self) -> list[tuple]:
        return []


def frame(slices: DataFrame, strict: bool = False) -> DataFrame:
    """``flow_id, ord, protocol, type, data, ts_us``: messages of each flow in the order they become whole; ts of the slice that ends them."""
    return by_flow(slices.select("flow_id", "arrival", "from_client", "data", "ts_us"), "flow_id", ["arrival"], lambda: Framing("HTTP", lambda side: HttpFramer(side, strict)), MESSAGE, MESSAGE_KINDS)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often and deep inside lambdas the body uses it."""
    return F.transform(F.array(value), body)[0]


def head_and_body(data: Column) -> tuple[Column, Column]:
    """Head as ISO-8859-1 text without its blank line, and body bytes; all head and no body without one."""
    text = F.decode(data, "ISO-8859-1")
    at = F.locate("\r\n\r\n", text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(data, at + 4, F.octet_length(data))).otherwise(F.lit(b""))


#: What counts as white space around names and values: all characters up to the space.
_WHITE = "".join(map(chr, range(33)))


def trimmed(text: Column) -> Column:
    """Text without characters up to U+0020 at either end."""
    return F.btrim(text, F.lit(_WHITE))


def _fields(lines: Column) -> Column:
    """Lower-cased names with all their values in order; a line that begins with white space goes on the one before."""
    unfolded = F.filter(F.split(F.regexp_replace(F.array_join(lines, "\r\n"), r"\r\n[ \t]+", ""), "\r\n"), lambda x: F.locate(":", x) > 1)
    pairs = F.transform(unfolded, lambda x: F.struct(F.lower(trimmed(F.substring_index(x, ":", 1))).alias("k"), trimmed(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    values = lambda ps, n: F.transform(F.filter(ps, lambda p: p["k"] == n), lambda p: p["v"])
    return let(pairs, lambda ps: let(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: values(ps, n)))))


def query_map(query: Column) -> Column:
    """Parameters by lower-cased name, URL-decoded, the last of a name winning; undecodable ones stay raw, empty names go."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.substring_index(p, "=", 1) != "")
    pairs = F.transform(parts, lambda p: F.struct(F.lower(plain(F.substring_index(p, "=", 1))).alias("k"), F.when(F.locate("=", p) > 0, plain(F.substring(p, F.locate("=", p) + 1, F.length(p)))).otherwise("").alias("v")))
    return _last_wins(pairs)


def cookie_map(header: Column) -> Column:
    """Cookies by lower-cased name, the last of a name winning; several headers are joined by semicolons."""
    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: trimmed(p)), lambda p: F.locate("=", p) > 1)
    return _last_wins(F.transform(parts, lambda p: F.struct(F.lower(trimmed(F.substring_index(p, "=", 1))).alias("k"), trimmed(F.substring(p, F.locate("=", p) + 1, F.length(p))).alias("v"))))


def _last_wins(pairs: Column) -> Column:
    last = lambda ps, n: F.element_at(F.filter(ps, lambda p: p["k"] == n), -1)["v"]
    return let(pairs, lambda ps: let(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: last(ps, n)))))


def first_value(fields: Column, name: str) -> Column:
    """A header's first value, null if it is missing."""
    return F.try_element_at(F.try_element_at(fields, F.lit(name)), F.lit(1))


def charset(content_type: Column) -> Column:
    """The declared charset in upper case, UTF-8 where none is declared."""
    named = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r'(?i)charset="?([A-Za-z0-9_:.-]+)', 1))
    return F.when(named == "", "UTF-8").otherwise(named)


def body_text(body: Column, content_type: Column) -> Column:
    """The body in its declared charset, in UTF-8 if that is unknown; what is malformed becomes U+FFFD, as the JVM does it."""
    kind = charset(content_type)
    named = F.when(kind.isin(*decodes_all_charsets(SparkSession.active())), kind).otherwise("UTF-8")
    return F.when(named == "UTF-8", F.decode(body, "UTF-8")).otherwise(F.call_function("decode", body, named))


def _first_words(data: Column) -> Column:
    return F.split(trimmed(F.substring_index(F.decode(data, "ISO-8859-1"), "\r\n", 1)), r"\s+", 3)


def is_request(data: Column) -> Column:
    """Whether the first line has two words at least."""
    return F.size(_first_words(data)) >= 2


def parse_request(data: Column) -> Column:
    """A struct of a request's parts; null if its first line has fewer than two words."""
    head, body = head_and_body(data)

    def parts(lines: Column, words: Column, fields: Column) -> Column:
        target = F.get(words, 1)
        return F.struct(
            words[0].alias("method"),
            F.substring_index(target, "?", 1).alias("path"),
            target.alias("raw_target"),
            F.coalesce(F.get(words, 2), F.lit("HTTP/1.1")).alias("http_version"),
            fields.alias("headers"),
            cookie_map(F.array_join(F.try_element_at(fields, F.lit("cookie")), ";")).alias("cookies"),
            query_map(F.when(F.locate("?", target) > 0, F.substring(target, F.locate("?", target) + 1, F.length(target)))).alias("query"),
            body.alias("body"),
        )

    parsed = let(F.split(head, "\r\n"), lambda lines: let(F.split(trimmed(lines[0]), r"\s+", 3), lambda words: let(_fields(_rest(lines)), lambda fields: parts(lines, words, fields))))
    return F.when(is_request(data), parsed)


def _rest(lines: Column) -> Column:
    return F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))


def parse_response(data: Column) -> Column:
    """A struct of a response's parts; null unless it begins with HTTP/; status -1 if it is no number."""
    head, body = head_and_body(data)

    def parts(lines: Column, words: Column) -> Column:
        return F.struct(F.coalesce(F.get(words, 1).try_cast("int"), F.lit(-1)).alias("status"), F.coalesce(F.get(words, 2), F.lit("")).alias("reason"), words[0].alias("http_version"), _fields(_rest(lines)).alias("headers"), body.alias("body"))

    parsed = let(F.split(head, "\r\n"), lambda lines: let(F.split(trimmed(lines[0]), r"\s+", 3), lambda words: parts(lines, words)))
    return F.when(F.startswith(F.decode(F.substring(data, 1, 5), "ISO-8859-1"), F.lit("HTTP/")), parsed)


def exchanges(pairs: DataFrame) -> DataFrame:
    """Pairs of messages as parsed ``request`` and ``response``, with times and latency; unparsable requests go.

    ``client`` and ``server`` (``ip, port``) are null where the pairs don't carry them.
    """
    r, p = parse_request(F.col("request.data")), parse_response(F.col("response.data"))
    ends = [(F.col(c) if c in pairs.columns else F.lit(None).cast("struct<ip: string, port: int>")).alias(c) for c in ("client", "server")]
    out = pairs.where(is_request(F.col("request.data"))).select("flow_id", "n", r.alias("http_request"), p.alias("http_response"), F.col("request.ts_us").alias("ts_us"), F.col("response.ts_us").alias("rsp_ts_us"), *ends)
    return out.select("*", F.when(F.col("rsp_ts_us").isNull(), -1).otherwise(F.greatest(F.lit(0).cast("long"), F.col("rsp_ts_us") - F.col("ts_us"))).cast("long").alias("latency_us"))
