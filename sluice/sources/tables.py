"""Segments, messages and exchanges derived from the star-schema tables, which hold no packets.

``events`` become segments between ``user_id``'s client and one of three servers; ``conversations`` become
messages; ``documents`` become byte chunks that arrive out of order; ``pages`` become request targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACK, FIN, PSH, SYN
from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment an event: even ids go to the server; signups open, some errors close, some clicks are bare acknowledgements."""
    e = read(spark, sf_dir, "events")
    up = F.expr("event_id % 2 = 0")
    bare = F.expr("event_type = 'click' AND event_id % 7 = 0")
    client = F.concat(F.lit("10.0.0."), F.expr("CAST(user_id % 250 AS STRING)"))
    server = F.concat(F.lit("10.1.0."), F.expr("CAST(1 + user_id % 3 AS STRING)"))
    client_port = F.expr("CAST(40000 + user_id AS INT)")
    server_port = F.expr("CASE user_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 23 ELSE 9000 END")
    bit = lambda cond, value: F.when(cond, value).otherwise(0)
    flags = bit(F.expr("event_type = 'error' AND event_id % 5 = 0"), FIN) + bit(F.expr("event_type = 'signup'") & up, SYN) + bit(F.expr("event_type = 'purchase'"), PSH) + bit(bare, ACK)
    return e.select(
        F.col("event_id").alias("arrival"),
        micros().alias("ts_us"),
        F.when(up, client).otherwise(server).alias("src_ip"),
        F.when(up, client_port).otherwise(server_port).alias("src_port"),
        F.when(up, server).otherwise(client).alias("dst_ip"),
        F.when(up, server_port).otherwise(client_port).alias("dst_port"),
        (F.col("event_id") * 16).alias("seq"),
        flags.alias("flags"),
        F.when(bare, F.lit("")).otherwise(F.col("props")).cast("binary").alias("payload"),
    )


def http_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange an event, in its user's conversation with one server: the request in two segments, the response in one.

    The second half of a request comes first, but for the first request of a flow; some errors' responses close the flow.
    """
    request, response = event_messages()
    key = ("event_id", "user_id", "closes", "ts_us")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.expr("CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END").alias("closes"), micros().alias("ts_us"), request.cast("binary").alias("q"), response.cast("binary").alias("p"))
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    e = e.select("*", F.coalesce(F.sum("closes").over(before), F.lit(0)).alias("inc"))
    past = W.partitionBy("user_id", "inc").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(F.octet_length(c)).over(past), F.lit(0))
    e = e.select(*key, "q", "p", total("q").alias("q_at"), total("p").alias("p_at"), (F.count("*").over(past) == 0).alias("first"))
    piece = lambda side, rank, seq, payload, flags: F.struct(F.lit(side).alias("up"), rank.alias("rank"), seq.alias("seq"), payload.alias("payload"), flags.alias("flags"))
    none = F.lit(PSH)
    parts = F.array(
        piece(True, F.when(F.col("first"), 0).otherwise(1), F.col("q_at"), F.expr("substring(q, 1, 30)"), none),
        piece(True, F.when(F.col("first"), 1).otherwise(0), F.col("q_at") + 30, F.expr("substring(q, 31)"), none),
        piece(False, F.lit(2), F.col("p_at"), F.col("p"), none + F.col("closes") * FIN),
    )
    s = e.select(*key, F.explode(parts).alias("s")).select(*key, "s.*")
    client, server = F.concat(F.lit("10.0.0."), F.expr("CAST(user_id % 250 AS STRING)")), F.lit("10.1.0.1")
    client_port, server_port = F.expr("CAST(40000 + user_id AS INT)"), F.lit(80)
    return s.select(
        (F.col("event_id") * 4 + F.col("rank")).cast("long").alias("arrival"),
        (F.col("ts_us") + F.col("rank") * 750).alias("ts_us"),
        F.when(F.col("up"), client).otherwise(server).alias("src_ip"),
        F.when(F.col("up"), client_port).otherwise(server_port).alias("src_port"),
        F.when(F.col("up"), server).otherwise(client).alias("dst_ip"),
        F.when(F.col("up"), server_port).otherwise(client_port).alias("dst_port"),
        F.col("seq").cast("long").alias("seq"),
        F.col("flags").cast("int").alias("flags"),
        "payload",
    )


def event_messages() -> tuple[Column, Column]:
    """An event's request and response as text: a request by its user for its type, answered with its properties."""
    text = lambda c: F.col(c).cast("string")
    method = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    cookie = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("JSESSIONID=s"), text("user_id"))).otherwise("x=1")
    request = F.concat(method, F.lit(" /u/"), text("user_id"), F.lit("/"), F.col("event_type"), F.lit("?K="), (F.col("event_id") % 9).cast("string"), F.lit(" HTTP/1.1\r\nHost: a\r\nUser-Agent: agent"), (F.col("event_id") % 3).cast("string"), F.lit("\r\nCookie: "), cookie, F.lit("\r\n\r\n"))
    return request, F.concat(F.lit("HTTP/1.1 "), status, F.lit(" X\r\nContent-Type: application/json\r\n\r\n"), F.col("props"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of a flow: users ask, all others answer."""
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "REQUEST").otherwise("RESPONSE")
    text = F.coalesce("text", F.lit(""))
    return c.select(F.col("conv_id").cast("string").alias("flow_id"), F.col("turn").alias("ord"), kind.alias("type"), text.cast("binary").alias("data"), (F.col("turn") * 1000 + F.length(text)).alias("ts_us"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 400) -> DataFrame:
    """Each document's text in pieces that arrive in scattered order and overlap: seq is the byte offset."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    k = d.select("doc_id", "b", F.explode(F.expr(f"sequence(0, CAST((length(b) - 1) / {size} AS INT))")).alias("k"))
    piece = k.select(F.col("doc_id").cast("string").alias("flow_id"), F.expr("k = 0").alias("head"), "k", (F.col("k") * size).cast("long").alias("seq"), F.expr(f"substring(b, k * {size} + 1, {size} + 25)").alias("payload"))
    return piece.select("flow_id", F.when(F.col("head"), 0).otherwise(1 + (F.col("k") * 7919) % 1009).cast("long").alias("arrival"), "seq", "payload", F.col("k").alias("chunk"))
