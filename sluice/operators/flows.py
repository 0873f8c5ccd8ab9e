"""Flow keys, incarnations and orientation, as windows over arrival order; segment filters and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACK, FIN, FLAGS, PSH, RST, SYN


def unpack_flags(segments: DataFrame) -> DataFrame:
    """A boolean column for each flag bit."""
    return segments.select("*", *(F.col("flags").bitwiseAND(bit).cast("boolean").alias(name) for name, bit in FLAGS.items()))


def pack_flags(**flags: Column) -> Column:
    """The bit mask of boolean columns named like the flags."""
    total = F.lit(0)
    for name, value in flags.items():
        total = total + F.when(value, FLAGS[name]).otherwise(0)
    return total.cast("int")


def is_pure_ack(flags: Column, payload: Column) -> Column:
    """An acknowledgement without data that neither opens, closes, resets nor pushes."""
    return (F.coalesce(F.octet_length(payload), F.lit(0)) == 0) & (flags.bitwiseAND(FIN | SYN | RST | PSH | ACK) == ACK)


def drop_pure_acks(segments: DataFrame) -> DataFrame:
    return segments.where(~is_pure_ack(F.col("flags"), F.col("payload")))


def with_payload(segments: DataFrame) -> DataFrame:
    return segments.where(F.octet_length("payload") > 0)


def _endpoint(side: str) -> Column:
    return F.concat_ws(":", F.col(f"{side}_ip"), F.col(f"{side}_port").cast("string"))


def conversation(segments: DataFrame) -> DataFrame:
    """``conv``: the two endpoints, the smaller by address text, then port, first; alike for either direction."""
    a, b = (F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")) for s in ("src", "dst"))
    low, high = F.least(a, b), F.greatest(a, b)
    text = lambda e: F.concat_ws(":", e["ip"], e["port"].cast("string"))
    return segments.select("*", F.concat_ws("|", text(low), text(high)).alias("conv"))


def orient(segments: DataFrame) -> DataFrame:
    """Adds ``conv, incarnation, client, from_client, flow_seq, flow_id``.

    A FIN or RST of either side closes the flow after its own segment; the next segment opens a new
    incarnation.  The client is the sender of the last SYN without ACK, else the incarnation's first sender.
    All windows share the partitioning by conversation: one shuffle.
    """
    closes = F.col("flags").bitwiseAND(FIN | RST) != 0
    opens = (F.col("flags").bitwiseAND(SYN) != 0) & (F.col("flags").bitwiseAND(ACK) == 0)
    past = (W.unboundedPreceding, -1)
    s = conversation(segments).select("*", closes.cast("long").alias("_closes"), _endpoint("src").alias("_src"))
    s = s.select("*", F.coalesce(F.sum("_closes").over(W.partitionBy("conv").orderBy("arrival").rowsBetween(*past)), F.lit(0)).alias("incarnation"))
    w = W.partitionBy("conv", "incarnation").orderBy("arrival").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.select("*", F.coalesce(F.last(F.when(opens, F.col("_src")), ignorenulls=True).over(w), F.first("_src").over(w)).alias("client"))
    s = s.select("*", (F.col("_src") == F.col("client")).alias("from_client"), F.coalesce(F.sum("_closes").over(W.partitionBy("conv", "client").orderBy("arrival").rowsBetween(*past)), F.lit(0)).alias("flow_seq"))
    return s.select("*", F.concat_ws("#", "conv", "client", F.col("flow_seq").cast("string")).alias("flow_id")).drop("_closes", "_src")


def server_port(oriented: DataFrame) -> Column:
    return F.when(F.col("from_client"), F.col("dst_port")).otherwise(F.col("src_port"))
