"""Running measures of keys of any length: a key's rows are cut into ranges of their order, and no task holds more than a range.

The windows of ``flows``, ``pairing`` and ``metrics`` put a key into one task.  Here rows are partitioned by key and range (``width`` of
the order column's values), each range is summed up in one row, the few sums of a key are scanned, and what went before a range comes back to
its rows by a join on key and range, for which the rows stay where they are.  Results are the same, column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACK, FIN, RST, SYN
from .flows import _endpoint, conversation

#: Values of the order column that a range spans.
WIDTH = 1 << 20
_PAST = (W.unboundedPreceding, -1)
_NOW = (W.unboundedPreceding, W.currentRow)


#: Key and range of a row; the key is a structure, which is never null, so that equal nulls meet in a plain join and rows keep their partitions.
_AT = ["_key", "_range"]


def _ranged(rows: DataFrame, keys: tuple[str, ...], order: str, width: int) -> DataFrame:
    return rows.withColumns({"_key": F.struct(*keys), "_range": F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62)))}).repartition(*_AT)


def _before(sums: DataFrame, **measures: Column) -> DataFrame:
    """For each range what all earlier ones of its key come to."""
    past = W.partitionBy("_key").orderBy("_range").rowsBetween(*_PAST)
    return sums.select(*_AT, *(m.over(past).alias(name) for name, m in measures.items()))


def orient(segments: DataFrame, width: int = WIDTH) -> DataFrame:
    """``flows.orient`` for conversations of any length, by ranges of ``arrival``."""
    flags = F.col("flags")
    opens = (flags.bitwiseAND(SYN) != 0) & (flags.bitwiseAND(ACK) == 0)
    s = conversation(segments).select("*", (flags.bitwiseAND(FIN | RST) != 0).cast("long").alias("_closes"), _endpoint("src").alias("_src"), F.substring_index("conv", "|", 1).alias("_low"))
    s = _ranged(s, ("conv",), "arrival", width)
    w = W.partitionBy(*_AT).orderBy("arrival")
    # An incarnation begins after a close, and with the conversation; whether a range's first row begins one, the range before tells.
    s = s.select("*", F.lag("_closes").over(w).alias("_last"), F.coalesce(F.sum("_closes").over(w.rowsBetween(*_PAST)), F.lit(0)).alias("_inc"))
    s = s.withColumn("_mark", F.when(opens | (F.col("_last") == 1), F.col("_src")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))
    sums = s.groupBy(*_AT).agg(F.sum("_closes").alias("closes"), F.max_by("_closes", "arrival").alias("last"), F.min_by("_src", "arrival").alias("first"), latest("_mark").alias("mark"))
    by = W.partitionBy("_key").orderBy("_range")
    sums = sums.select("*", (F.coalesce(F.lag("last").over(by), F.lit(1)) == 1).alias("_begins"))
    sums = sums.withColumn("mark", F.coalesce("mark", F.when(F.col("_begins"), F.col("first"))))
    carried = _before(sums, _inc_before=F.sum("closes"), _client_before=F.last("mark", ignorenulls=True))
    s = s.join(carried.join(sums.select(*_AT, "_begins"), _AT), _AT)
    mark = F.coalesce("_mark", F.when(F.col("_last").isNull() & F.col("_begins"), F.col("_src")))
    s = s.withColumn("_mark", mark)
    s = s.withColumns({"incarnation": F.col("_inc") + F.coalesce("_inc_before", F.lit(0)), "client": F.coalesce(F.last("_mark", ignorenulls=True).over(w.rowsBetween(*_NOW)), "_client_before")})
    # A conversation has two ends, so closes under either as the client are two sums.
    s = s.withColumns({"from_client": F.col("_src") == F.col("client"), "_is_low": F.col("client") == F.col("_low")})
    closed = lambda low: F.when(F.col("_is_low") == low, F.col("_closes")).otherwise(0)
    sides = s.groupBy(*_AT).agg(F.sum(closed(True)).alias("low"), F.sum(closed(False)).alias("high"))
    s = s.join(_before(sides, _low_before=F.sum("low"), _high_before=F.sum("high")), _AT)
    here = F.coalesce(F.sum("_closes").over(W.partitionBy(*_AT, "client").orderBy("arrival").rowsBetween(*_PAST)), F.lit(0))
    s = s.withColumn("flow_seq", here + F.coalesce(F.when(F.col("_is_low"), F.col("_low_before")).otherwise(F.col("_high_before")), F.lit(0)))
    return s.select("*", F.concat_ws("#", "conv", "client", F.col("flow_seq").cast("string")).alias("flow_id")).select(*segments.columns, "conv", "incarnation", "client", "from_client", "flow_seq", "flow_id")


def http_ordinals(messages: DataFrame, keys: tuple[str, ...] = ("flow_id",), width: int = WIDTH) -> DataFrame:
    """``pairing.http_ordinals`` for flows of any length, by ranges of ``ord``: the walk's sum and its least value carry over."""
    request = F.col("type") == "REQUEST"
    m = _ranged(messages, keys, "ord", width)
    w = W.partitionBy(*_AT).orderBy("ord")
    now = w.rowsBetween(*_NOW)
    m = m.select("*", F.sum(F.when(request, 1).otherwise(-1)).over(now).alias("_s"), F.count(F.when(request, 1)).over(now).alias("_q"), F.count(F.when(~request, 1)).over(now).alias("_p"))
    sums = m.groupBy(*_AT).agg(F.max_by("_s", "ord").alias("s"), F.min("_s").alias("least"), F.max("_q").alias("q"), F.max("_p").alias("p"))
    carried = _before(sums, _s_before=F.sum("s"), _q_before=F.sum("q"), _p_before=F.sum("p"))
    sums = sums.join(carried, _AT).withColumn("least", F.col("least") + F.coalesce("_s_before", F.lit(0)))
    least = _before(sums, _least_before=F.min("least"))
    m = m.join(carried.join(least, _AT), _AT)
    zero = lambda c: F.coalesce(c, F.lit(0))
    least_now = F.least(F.min(F.col("_s") + zero("_s_before")).over(now), F.col("_least_before"))  # least skips nulls
    m = m.withColumn("_u", F.greatest(F.lit(0), -least_now))
    m = m.withColumn("_was", F.coalesce(F.lag("_u").over(w), F.greatest(F.lit(0), -F.col("_least_before")), F.lit(0)))
    q, p = F.col("_q") + zero("_q_before"), F.col("_p") + zero("_p_before")
    n = F.when(request, q).when(F.col("_u") == F.col("_was"), p - F.col("_u"))
    return m.select(*messages.columns, n.alias("n"))


def high_water(rows: DataFrame, key: str, order: str, value: str, width: int = WIDTH) -> DataFrame:
    """``metrics.high_water`` for keys of any length."""
    r = _ranged(rows, (key,), order, width)
    r = r.join(_before(r.groupBy(*_AT).agg(F.max(value).alias("most")), _before_=F.max("most")), _AT)
    here = F.max(value).over(W.partitionBy(*_AT).orderBy(order).rowsBetween(*_NOW))
    return r.select(*rows.columns, F.greatest(here, "_before_").alias("high_water"))


def active(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, width: int = WIDTH) -> DataFrame:
    """``metrics.active`` for keys of any length."""
    step = F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)
    r = _ranged(rows.withColumn("_step", step), (key,), order, width)
    r = r.join(_before(r.groupBy(*_AT).agg(F.sum("_step").alias("sum")), _before_=F.sum("sum")), _AT)
    here = F.sum("_step").over(W.partitionBy(*_AT).orderBy(order).rowsBetween(*_NOW))
    return r.select(*rows.columns, (here + F.coalesce("_before_", F.lit(0))).alias("active"))
