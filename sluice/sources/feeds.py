"""Line feeds: JSON segments, pairs and events as a message bus carries them, samples.

The bus itself is Spark's ``kafka`` source and sink where its jar is installed; the same columns go over text files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import plain_base64
from ..schemas import SEGMENT_JSON


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A stream of ``key, value`` from the bus, from the earliest offset."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load()


def parse_segments(lines: DataFrame, value: str = "value", order: Column | None = None) -> DataFrame:
    """Segments of JSON lines; lines that don't parse, or lack an address, are dropped."""
    j = F.from_json(F.col(value).cast("string"), SEGMENT_JSON)
    s = lines.select((order if order is not None else F.monotonically_increasing_id()).alias("arrival"), j.alias("j")).where("j.src IS NOT NULL AND j.dst IS NOT NULL")
    return s.select("arrival", F.col("j.ts").alias("ts_us"), F.col("j.src").alias("src_ip"), F.col("j.sport").alias("src_port"), F.col("j.dst").alias("dst_ip"), F.col("j.dport").alias("dst_port"), "j.seq", "j.flags", F.coalesce(F.expr("try_to_binary(j.payload, 'base64')"), F.lit(b"")).alias("payload"))


def segment_json(segments: DataFrame, *more: str) -> DataFrame:
    """``key, value``, and columns ``more``: the directional flow and the segment as JSON."""
    end = lambda s: F.concat_ws(":", f"{s}_ip", F.col(f"{s}_port").cast("string"))
    body = F.struct(F.col("ts_us").alias("ts"), F.col("src_ip").alias("src"), F.col("src_port").alias("sport"), F.col("dst_ip").alias("dst"), F.col("dst_port").alias("dport"), "seq", "flags", plain_base64(F.col("payload")).alias("payload"))
    return segments.select(F.concat_ws(">", end("src"), end("dst")).alias("key"), F.to_json(body).alias("value"), *more)


def _json(parts: dict[str, Column]) -> Column:
    """A JSON object of values that are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))


def _text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def pair_json(pairs: DataFrame, protocol: str) -> DataFrame:
    """``key, value`` of pairs with ``tx_id, client, server``: both sides with time, direction, length and content; a side that lacks is null.

    HTTP sides have the first line, the head as text and the body in base64, others all bytes in base64.
    """

    def side(name: str) -> Column:
        s = F.col(name)
        text = F.decode(s["data"], "ISO-8859-1")
        at = F.locate("\r\n\r\n", text)
        head = F.regexp_replace(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
        parts = {"timestamp": s["ts_us"].cast("string"), "direction": _text(F.lit(name.upper())), "length": F.octet_length(s["data"]).cast("string")}
        if protocol == "HTTP":
            body = F.when(at > 0, F.substring(s["data"], at + 4, F.octet_length(s["data"]))).otherwise(F.lit(b""))
            parts |= {"firstLine": _text(F.trim(F.regexp_replace(F.substring_index(head, "\n", 1), "\r", ""))), "headers": _text(head), "bodyB64": _text(plain_base64(body)), "metadataTxId": _text(F.col("tx_id"))}
        else:
            parts["payloadB64"] = _text(plain_base64(s["data"]))
        if "attributes" in pairs.schema[name].dataType.names:
            parts["attributes"] = F.when(F.size(s["attributes"]) > 0, F.to_json(s["attributes"]))
        return F.when(s.isNotNull(), _json(parts)).otherwise("null")

    end = lambda c: _json({"ip": _text(F.col(c)["ip"]), "port": F.coalesce(F.col(c)["port"], F.lit(0)).cast("string")})
    times = [F.coalesce(f("request.ts_us", "response.ts_us"), F.lit(0).cast("long")).cast("string") for f in (F.least, F.greatest)]
    value = {"protocol": _text(F.lit(protocol)), "txId": _text(F.col("tx_id")), "startTs": times[0], "endTs": times[1], "client": end("client"), "server": end("server"), "request": side("request"), "response": side("response")}
    return pairs.select(F.col("tx_id").alias("key"), _json(value).alias("value"))


def event_id(ts_us: Column, *unique: Column) -> Column:
    """26 characters that sort by time: milliseconds, then 80 bits of a hash, in base 32 without I, L, O, U. Alike when a task runs again."""
    base32 = lambda x, n: F.lpad(F.translate(x, "IJKLMNOPQRSTUV", "JKMNPQRSTVWXYZ"), n, "0")
    digest = F.sha2(F.concat_ws("|", *unique), 256)
    return F.concat(base32(F.conv(F.floor(ts_us / 1000).cast("string"), 10, 32), 10), *(base32(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8) for k in range(2)))


def terminal_json(events: DataFrame, screens: str = "screen-renders", actions: str = "user-actions", source: str = "terminal-assembler", host: str | None = None, emitted: Column | None = None) -> DataFrame:
    """``topic, key, value``: screens go to one topic, what users do to another. Parts that an event's type lacks are left out."""
    kind = F.col("type")
    submit, render = kind == "USER_SUBMIT", kind == "SCREEN_RENDER"
    of = lambda when, value: F.when(when, value)
    terminal = F.struct(
        of(submit, F.coalesce("aid", F.lit("UNKNOWN"))).alias("aid"),
        of(render, F.col("rows")).alias("rows"),
        of(render, F.col("cols")).alias("cols"),
        of(submit | render, F.col("screen_hash")).alias("screenHash"),
        F.col("screen_name").alias("screenName"),
        of(submit, F.coalesce("inputs", F.create_map().cast("map<string,string>"))).alias("inputs"),
        of(render, F.coalesce("fields", F.array().cast(events.schema["fields"].dataType))).alias("fields"),
    )
    at = F.date_format(F.to_utc_timestamp(emitted if emitted is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pipeline = F.struct(F.lit(source).alias("source"), *([F.lit(host).alias("host")] if host else []))
    value = F.struct(F.lit(1).alias("schemaVersion"), event_id(F.col("ts_us"), F.col("session_key"), F.col("n").cast("string")).alias("eventId"), at.alias("emittedAt"), kind.alias("type"), F.struct(F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId")).alias("session"), terminal.alias("tn3270"), pipeline.alias("pipeline"))
    return events.select(F.when(render, screens).otherwise(actions).alias("topic"), F.col("session_key").alias("key"), F.to_json(value).alias("value"))


def to_kafka(lines: DataFrame, servers: str, topic: str | None = None, **options: str) -> None:
    """Rows of ``key, value`` (and ``topic``, unless one is given) to the bus; every record is acknowledged by all replicas."""
    rows = lines.select(*(c for c in ("topic", "key", "value") if c in lines.columns and not (c == "topic" and topic)))
    rows.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "kafka.acks": "all", **({"topic": topic} if topic else {}), **options}).save()


def report_lines(reports: DataFrame) -> DataFrame:
    """``key, value``: reports as the bus carries them, by transaction."""
    return reports.select(F.col("tx_id").alias("key"), F.col("content").alias("value"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """``flow_id, n, request, response`` of files ``<name>-request.txt`` and ``<name>-response.txt``; line ends become CRLF, responses may lack; by name."""

    def side(kind: str, ts: int) -> DataFrame:
        files = spark.read.text(f"{folder}/*-{kind}.txt", wholetext=True).select("value", "_metadata.file_name")
        name = F.regexp_replace("file_name", f"-{kind}\\.txt$", "")
        return files.select(name.alias("flow_id"), F.struct(F.regexp_replace("value", "\r?\n", "\r\n").cast("binary").alias("data"), F.lit(ts).cast("long").alias("ts_us")).alias(kind))

    return side("request", 1000).join(side("response", 2000), "flow_id", "left").select("flow_id", F.lit(1).cast("long").alias("n"), "request", "response").orderBy("flow_id")


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as Parquet by protocol, the store that the rest of this package reads."""
    messages.write.partitionBy("protocol").parquet(path)


def protocol_lines(pairs: DataFrame, *more: str) -> DataFrame:
    """``value``, and columns ``more``: each pair's protocol alone as JSON, as the oldest store kept it."""
    return pairs.select(F.to_json(F.struct("protocol")).alias("value"), *more)


def route(pairs: DataFrame, writers: dict) -> None:
    """Rows to the writer of their protocol; those of no writer go nowhere."""
    for protocol, write in writers.items():
        write(pairs.where(F.col("protocol") == protocol))


def disabled(spark: SparkSession, schema: str, start: bool = False) -> DataFrame:
    """A source that is switched off: no rows, and an error if it is to ``start``."""
    if start:
        raise RuntimeError("this source is switched off")
    return spark.createDataFrame([], schema)


PAIR_SIDE = "struct<timestamp: bigint, firstLine: string, headers: string, bodyB64: string, payloadB64: string, status: int, attributes: map<string,string>>"


def parse_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """``tx_id, request, response`` of pairs as JSON, with missing parts at their defaults; lines that don't parse are dropped."""
    j = F.from_json(F.col(value).cast("string"), f"struct<txId: string, startTs: bigint, endTs: bigint, request: {PAIR_SIDE}, response: {PAIR_SIDE}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})

    def side(name: str, status: int) -> Column:
        s = F.col(f"j.{name}")
        body = F.coalesce(F.expr(f"try_to_binary(coalesce(j.{name}.bodyB64, j.{name}.payloadB64), 'base64')"), F.lit(b""))
        return F.struct(F.coalesce(s["timestamp"], F.lit(0).cast("bigint")).alias("ts_us"), F.coalesce(s["firstLine"], F.lit("")).alias("first_line"), F.coalesce(s["headers"], F.lit("")).alias("headers"), body.alias("data"), F.coalesce(s["status"], F.lit(status)).alias("status"), s["attributes"].alias("attributes"))

    good = lines.select(j.alias("j")).where("j IS NOT NULL AND j._corrupt IS NULL")
    return good.select(F.coalesce("j.txId", F.lit("tx-unknown")).alias("tx_id"), F.coalesce("j.startTs", F.lit(0).cast("bigint")).alias("start_ts"), side("request", 0).alias("request"), side("response", 200).alias("response"))


def pair_reports(pairs: DataFrame, decode: bool = False) -> DataFrame:
    """``tx_id, content``: parsed pairs as short reports; ``decode`` undoes chunks and gzip that the headers name."""
    from ..operators.reports import decode_message

    @F.pandas_udf("binary")
    def plain(headers, data):
        out = []
        for h, d in zip(headers, data, strict=True):
            whole = "\r\n".join(["x", *(h or "").splitlines()]).encode("latin-1", "replace") + b"\r\n\r\n" + bytes(d or b"")
            out.append(decode_message(whole).partition(b"\r\n\r\n")[2])
        return pd.Series(out)

    def side(title: str, name: str) -> Column:
        s = F.col(name)
        body = F.decode(plain(s["headers"], s["data"]) if decode else s["data"], "ISO-8859-1")
        line = lambda c: F.when(F.trim(c) != "", F.concat(c, F.lit("\n"))).otherwise("")
        return F.concat(F.lit(f"HTTP {title}\n"), line(s["first_line"]), F.when(F.length(body) > 0, F.concat(body, F.lit("\n"))).otherwise(""))

    pairs_of = F.transform(F.array_sort(F.map_entries(F.col("request.attributes"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    attrs = F.when(F.size(pairs_of) > 0, F.concat(F.lit("# attrs: "), F.array_join(pairs_of, " "), F.lit("\n"))).otherwise("")
    return pairs.select("tx_id", F.concat(side("REQUEST", "request"), side("RESPONSE", "response"), F.coalesce(attrs, F.lit(""))).alias("content"))
