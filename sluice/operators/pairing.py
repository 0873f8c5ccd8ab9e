"""Pairing of requests and responses in a flow, without state machines.

A first-in first-out queue whose orphan responses are dropped is a reflected walk (Lindley): with +1 for a
request and -1 for a response, ``u = max(0, -min prefix)`` grows exactly where a response finds no request.
So pairs are an equi-join of ordinals after one windowed pass.

``keys`` name a flow.  Where a flow's segments are already partitioned, by conversation say, give that key before
``flow_id`` and the windows and groups here reuse the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def http_ordinals(messages: DataFrame, keys: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """Adds ``n``, the number of the transaction that a message belongs to; null for orphan responses."""
    w = W.partitionBy(*keys).orderBy("ord")
    to_now = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    request = F.col("type") == "REQUEST"
    m = messages.select("*", F.sum(F.when(request, 1).otherwise(-1)).over(to_now).alias("_s"))
    m = m.select("*", F.greatest(F.lit(0), -F.min("_s").over(to_now)).alias("_u"))
    m = m.select("*", F.coalesce(F.lag("_u").over(w), F.lit(0)).alias("_before"), F.count(F.when(request, 1)).over(to_now).alias("_q"), F.count(F.when(~request, 1)).over(to_now).alias("_p"))
    n = F.when(request, F.col("_q")).when(F.col("_u") == F.col("_before"), F.col("_p") - F.col("_u"))
    return m.select("*", n.alias("n")).drop("_s", "_u", "_before", "_q", "_p")


def http_pairs(messages: DataFrame, keep_unanswered: bool = False, keys: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """``flow_id, n, request, response``; with ``keep_unanswered`` the pending requests too, as a flush gives them.

    A transaction has one request and one response at most, so both fold into one group of the same partitioning.
    """
    cols = [c for c in messages.columns if c not in (*keys, "type")]
    kept = http_ordinals(messages, keys).where("n IS NOT NULL")
    both = kept.groupBy(*keys, "n").agg(*(F.first(F.when(F.col("type") == t, F.struct(*cols)), ignorenulls=True).alias(name) for t, name in (("REQUEST", "request"), ("RESPONSE", "response"))))
    return both if keep_unanswered else both.where("response IS NOT NULL")


def two_way_pairs(messages: DataFrame, keys: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """The k-th request with the k-th response, whichever leads; nothing is dropped, unmatched ones wait."""
    cols = [c for c in messages.columns if c not in (*keys, "type")]
    numbered = messages.select("*", F.row_number().over(W.partitionBy(*keys, "type").orderBy("ord")).alias("n"))
    both = numbered.groupBy(*keys, "n").agg(*(F.first(F.when(F.col("type") == t, F.struct(*cols)), ignorenulls=True).alias(name) for t, name in (("REQUEST", "request"), ("RESPONSE", "response"))))
    return both.where("request IS NOT NULL AND response IS NOT NULL")


def with_tx_id(messages: DataFrame, minted_by: str = "REQUEST", keys: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """Adds a deterministic ``tx_id``: the minting side starts transactions, the other takes the oldest pending one's or, with none, its own."""
    roles = F.when(F.col("type") == minted_by, "REQUEST").otherwise("RESPONSE")
    n = http_ordinals(messages.select("*", F.col("type").alias("_own")).withColumn("type", roles), keys).withColumn("type", F.col("_own")).drop("_own")
    key = F.coalesce(F.concat(F.lit("t"), F.col("n").cast("string")), F.concat(F.lit("o"), F.col("ord").cast("string")))
    return n.select("*", F.substring(F.sha2(F.concat_ws("|", "flow_id", key), 256), 1, 26).alias("tx_id")).drop("n")


def latency(pairs: DataFrame) -> DataFrame:
    """Adds ``latency_us``: never below 0, and -1 without a response."""
    wait = F.greatest(F.lit(0).cast("long"), F.col("response.ts_us") - F.col("request.ts_us"))
    return pairs.select("*", F.when(F.col("response").isNull(), -1).otherwise(wait).cast("long").alias("latency_us"))
