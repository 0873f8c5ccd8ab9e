"""Protocol recognition: by server port, by signature of the first bytes where ports don't decide."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ports that each protocol claims, and methods whose name and a space begin an HTTP request.
PORTS = {"HTTP": (80, 8080, 8000, 3128), "TN3270": (23, 992)}
METHODS = ("GET", "POST", "PUT", "HEAD", "DELETE", "OPTIONS", "TRACE", "PATCH")
PREFACE_BYTES = 512


def has_http_signature(data: Column) -> Column:
    """Bytes that begin like an HTTP request or response."""
    return F.rlike(F.decode(F.substring(data, 1, 16), "ISO-8859-1"), F.lit(f"^(?:(?:{'|'.join(METHODS)}) |HTTP/)"))


def has_telnet_signature(data: Column) -> Column:
    """Any 0xFF byte."""
    return F.rlike(F.hex(data), F.lit("^(?:..)*FF"))


def classify(port: Column, preface: Column, ports: dict[str, tuple[int, ...]] | None = None) -> Column:
    """The one protocol that claims ``port``; where none or several do, the one whose signature the preface has; else UNKNOWN."""
    ports = PORTS if ports is None else ports
    claims = sum((port.isin(*p).cast("int") for p in ports.values()), F.lit(0))
    by_port = F.coalesce(*(F.when(port.isin(*p), F.lit(name)) for name, p in ports.items()))
    http, telnet = F.coalesce(has_http_signature(preface), F.lit(False)), F.coalesce(has_telnet_signature(preface), F.lit(False))
    by_bytes = F.when(http & ~telnet, "HTTP").when(telnet & ~http, "TN3270").otherwise("UNKNOWN")
    return F.when(claims == 1, by_port).otherwise(by_bytes)


_HTTP = re.compile(f"(?:(?:{'|'.join(METHODS)}) |HTTP/)".encode())


def http_begins(preface: bytes) -> bool:
    """``has_http_signature`` for a machine."""
    return _HTTP.match(preface) is not None


def telnet_marks(preface: bytes) -> bool:
    """``has_telnet_signature`` for a machine."""
    return b"\xff" in preface


def preface(oriented: DataFrame, limit: int = PREFACE_BYTES) -> DataFrame:
    """``flow_id, preface``: the first bytes of a flow, both directions in arrival order."""
    w = W.partitionBy("flow_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    s = oriented.where(F.octet_length("payload") > 0).select("flow_id", "arrival", "payload", F.coalesce(F.sum(F.octet_length("payload")).over(w), F.lit(0)).alias("before"))
    cut = s.where(F.col("before") < limit).select("flow_id", "arrival", F.expr(f"substring(payload, 1, CAST({limit} - before AS INT))").alias("payload"))
    joined = F.expr("concat_ws('', transform(array_sort(collect_list(struct(arrival, hex(payload) AS h))), x -> x.h))")
    return cut.groupBy("flow_id").agg(F.unhex(joined).alias("preface"))


def of_protocol(pairs: DataFrame, protocol: str, protocol_col: str = "protocol") -> DataFrame:
    """Pairs of one protocol, as rules (HTTP) and the terminal assembler (TN3270) take them."""
    return pairs.where(F.col(protocol_col) == protocol)


def index_entries_of(index: DataFrame, protocol: str) -> DataFrame:
    """Index entries of one protocol: HTTP entries have a head, others none."""
    head = F.coalesce("headers_len", F.lit(0)) > 0
    return index.where(head if protocol == "HTTP" else ~head)


def only_enabled(flows: DataFrame, enabled: list[str], protocol_col: str = "protocol") -> DataFrame:
    return flows.where(F.col(protocol_col).isin(*enabled))
