"""Readable reports of transactions: regrouped sides, decoded bodies, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import decode_body, decode_chunked, hex_dump, likely_text, safe_name


def regroup(messages: DataFrame, key: str = "tx_id", order: str = "ord") -> DataFrame:
    """``key, use, request, response``: both sides of each transaction, the last row of a side winning; either may lack.

    An id may be used again: in ``order``, a transaction ends with the row that gives it its other side, and the next row begins another;
    ``use`` counts them from 1.  Nothing is collected for this.  In runs of rows of one side, a run's first row ends a transaction if
    one is open.  It is after a run of several rows, and else just if it wasn't before the last run; so what counts is the number of runs since
    the last long one.  All windows and the grouping share one shuffle by id.
    """
    cols = [c for c in messages.columns if c not in (key, "type")]
    w = W.partitionBy(key).orderBy(order)
    so_far, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    goes_on = F.coalesce(F.lag("type").over(w) == F.col("type"), F.lit(False))
    m = messages.select("*", goes_on.alias("_on"))
    m = m.select("*", F.sum((~F.col("_on")).cast("int")).over(so_far).alias("_run"), (~F.col("_on") & F.coalesce(F.lag("_on").over(w), F.lit(False))).alias("_after_long"))
    m = m.select("*", F.max(F.when(F.col("_after_long"), F.col("_run"))).over(so_far).alias("_open_at"))
    is_open = F.coalesce((F.col("_run") - F.col("_open_at")) % 2 == 0, F.col("_run") % 2 == 0)
    m = m.select("*", (~F.col("_on") & is_open).cast("long").alias("_ends"))
    m = m.select("*", (1 + F.coalesce(F.sum("_ends").over(before), F.lit(0))).alias("use"))
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.struct(*cols)), F.when(F.col("type") == kind, F.col(order)))
    return m.groupBy(key, "use").agg(last("REQUEST").alias("request"), last("RESPONSE").alias("response"))


def decode_message(data: bytes, mode: str = "all") -> bytes:
    """A message without its transfer coding (``transfer``) and content coding (``all``); the length is written anew."""
    head, blank, body = data.partition(b"\r\n\r\n")
    if not blank or mode == "none":
        return data
    lines = head.decode("latin-1").split("\r\n")
    fields = {n.strip().lower(): v.strip().lower() for n, c, v in (x.partition(":") for x in lines[1:]) if c}
    gone = set()
    if "chunked" in fields.get("transfer-encoding", ""):
        try:
            body = decode_chunked(body)
            gone |= {"transfer-encoding", "content-length"}
        except ValueError:
            pass
    if mode == "all" and (coding := fields.get("content-encoding")) in ("gzip", "deflate"):
        plain = decode_body(body, coding)
        if plain != body:
            body = plain
            gone |= {"content-encoding", "content-length"}
    if gone:
        lines = [x for x in lines if x.partition(":")[0].strip().lower() not in gone] + [f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + body


def _decoded(data: Column, mode: str) -> Column:
    if mode == "none":
        return data

    @F.pandas_udf("binary")
    def run(values):
        return values.map(lambda v: None if v is None else decode_message(bytes(v), mode))

    return run(data)


def _lines(*parts: Column) -> Column:
    return F.concat(*(F.concat(p, F.lit("\n")) for p in parts))


def _marks(side: Column, columns: list[str]) -> Column:
    end = lambda c: F.coalesce(side[c], F.lit("")) if c in columns else F.lit("")
    return _lines(F.concat(F.lit("# timestamp_us: "), side["ts_us"].cast("string")), F.concat(F.lit("# src: "), end("src")), F.concat(F.lit("# dst: "), end("dst")), F.lit(""))


def _section(title: str, side: Column, text: Column) -> Column:
    kind = title.rsplit(" ", 1)[1].lower()
    return F.concat(F.lit(f"=== {title} ===\n"), F.when(side.isNotNull(), text).otherwise(f"(no {kind} captured)\n"))


def _http_side(title: str, side: Column, data: Column, tx: Column, columns: list[str]) -> Column:
    text = F.decode(data, "ISO-8859-1")
    at = F.locate("\r\n\r\n", text)
    field = lambda x: F.when(F.locate(":", x) > 1, F.concat(F.trim(F.substring_index(x, ":", 1)), F.lit(": "), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))))).otherwise(F.concat(x, F.lit(": ")))
    lines = F.split(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), "\r\n")
    head = F.array_join(F.transform(lines, lambda x, k: F.when(k == 0, x).otherwise(field(x))), "\n")
    body = F.when(at > 0, F.substring(data, at + 4, F.octet_length(data))).otherwise(F.lit(b""))
    plain = F.decode(body, "ISO-8859-1")
    shown = F.when(F.octet_length(body) == 0, "(empty body)\n").when(likely_text(body), F.concat(plain, F.when(F.rlike(plain, F.lit(r"[\r\n]\z")), "").otherwise("\n")))
    shown = shown.otherwise(F.concat(F.lit("[binary payload "), F.octet_length(body).cast("string"), F.lit(" bytes]\n"), hex_dump(body)))
    return _section(f"HTTP {title}", side, F.concat(_lines(F.concat(F.lit("# id: "), F.coalesce(tx, F.lit("")))), _marks(side, columns), _lines(head, F.lit("")), shown))


def _side_columns(transactions: DataFrame, side: str) -> list[str]:
    return transactions.schema[side].dataType.names


def http_reports(transactions: DataFrame, mode: str = "all", key: str = "tx_id") -> DataFrame:
    """``protocol, tx_id, ts_us, content, file_name`` of regrouped HTTP transactions; sides may carry ``src`` and ``dst``."""
    t = transactions.select(F.col(key).alias("tx_id"), "request", "response", _decoded(F.col("request.data"), mode).alias("_q"), _decoded(F.col("response.data"), mode).alias("_p"))
    q = _http_side("REQUEST", F.col("request"), F.col("_q"), F.col("tx_id"), _side_columns(t, "request"))
    p = _http_side("RESPONSE", F.col("response"), F.col("_p"), F.col("tx_id"), _side_columns(t, "response"))
    return _report(t, "HTTP", F.concat_ws("\n", q, p), ".http")


def terminal_reports(transactions: DataFrame, key: str = "tx_id") -> DataFrame:
    """The same of terminal transactions: each side as a hex dump."""
    t = transactions.select(F.col(key).alias("tx_id"), "request", "response")
    side = lambda title, name: _section(f"TN3270 {title}", F.col(name), F.concat(_marks(F.col(name), _side_columns(t, name)), F.when(F.octet_length(F.col(name)["data"]) > 0, hex_dump(F.col(name)["data"])).otherwise("(empty payload)\n")))
    return _report(t, "TN3270", F.concat_ws("\n", side("REQUEST", "request"), side("RESPONSE", "response")), ".tn3270.txt")


def _report(t: DataFrame, protocol: str, content: Column, suffix: str) -> DataFrame:
    ts = F.coalesce(F.least("request.ts_us", "response.ts_us"), F.lit(0).cast("long"))
    return t.select(F.lit(protocol).alias("protocol"), "tx_id", ts.alias("ts_us"), content.alias("content"), F.concat(ts.cast("string"), F.lit("_"), safe_name(F.col("tx_id")), F.lit(suffix)).alias("file_name"))


def write_reports(reports: DataFrame, folder: str) -> None:
    """One text file a report, in a shared folder; a file appears once it is whole."""

    def write(rows) -> None:
        from ..sources._files import locate, put

        store, base = locate(folder)
        store.create_dir(base)
        for r in rows:
            put(store, f"{base}/{r['file_name']}", r["content"].encode())

    reports.select("file_name", "content").foreachPartition(write)
