"""Counters, histograms and running measures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import DoubleType, StructField, StructType


def counters(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("metric")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("metric")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Percentiles by nearest rank: the smallest value that so large a share does not exceed."""
    picks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in shares]
    return rows.groupBy(F.col(key).alias("metric")).agg(*picks)


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.85) -> DataFrame:
    """Exponential moving average of each key's values in order: the first seeds it, and a mean of exactly 0 is seeded anew.

    A key's values are sorted and folded in one task, batch by batch, so that a key of any length needs no array of its values.
    """
    values = rows.select(F.col(key).alias("metric"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    ordered = values.repartition("metric").sortWithinPartitions("metric", "o", "v").select("metric", "v")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, mean, some = None, None, 0.0, False
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not (some and (k == now or (k != k and now != now))):
                    if some:
                        done.append((now, mean))
                    now, mean, some = k, 0.0, True
                if mean is not None:  # null stays null
                    mean = x if mean == 0 else None if x is None else alpha * mean + (1 - alpha) * x
            yield _means(done, kind)
        if some:
            yield _means([(now, mean)], kind)

    return ordered.mapInArrow(fold, StructType([StructField("metric", ordered.schema["metric"].dataType), StructField("ema", DoubleType())]))


def _means(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([m for _, m in done], pa.float64())], names=["metric", "ema"])


def high_water(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds the running maximum."""
    return rows.select("*", F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)).alias("high_water"))


def active(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Adds how many are open: those opened so far less those closed."""
    step = F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)
    return rows.select("*", F.sum(step).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)).alias("active"))


def grep(rows: DataFrame, needle: bytes, data: str = "payload", context: int = 32) -> DataFrame:
    """The first place of ``needle`` in each payload that holds it, ``at``, and the printable bytes around it, ``around``."""
    if not needle or not 1 <= context <= 4096:
        raise ValueError("needle must not be empty, context must lie in 1..4096")
    text = F.decode(data, "ISO-8859-1")  # a character a byte
    at = F.locate(needle.decode("latin-1"), text) - 1
    hit = rows.select("*", text.alias("_t"), at.cast("long").alias("at")).where("at >= 0")
    first = F.greatest(F.lit(0), F.col("at") - context)
    around = F.substring(F.col("_t"), (first + 1).cast("int"), (F.col("at") + len(needle) + context - first).cast("int"))
    return hit.select("*", F.regexp_replace(around, r"[^\x20-\x7e]", ".").alias("around")).drop("_t")


def waits(rows: DataFrame, name: str, wait: Column) -> DataFrame:
    """``metric, waits, total``: how often and how long in all something waited."""
    return rows.groupBy(F.col(name).alias("metric")).agg(F.count(wait).alias("waits"), F.coalesce(F.sum(wait), F.lit(0)).cast("long").alias("total"))


def grep_totals(segments: DataFrame, needle: bytes) -> DataFrame:
    """``scanned, matched``: the summary of a payload search."""
    return segments.agg(F.count("*").alias("scanned"), F.count_if(F.contains("payload", F.lit(needle))).alias("matched"))


def observed(rows: DataFrame, to: Observation | str, counts: dict[str, Column], measures: dict[str, Column] | None = None) -> DataFrame:
    """The rows, unchanged, with counts (of rows for which a column is true) and histograms taken as they pass: no pass or shuffle of its own.

    A batch's come to an ``Observation``, whose ``get`` waits for the first action; a stream's go by a name into its progress, where ``Totals`` adds them up.
    """
    parts = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]
    parts += [F.struct(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most")).alias(k) for k, c in (measures or {}).items()]
    return rows.observe(to, *parts)


def segment_metrics(prefix: str = "live") -> tuple[dict[str, Column], dict[str, Column]]:
    """Counts and measures of raw segments, for ``observed``: all of them, those that are bare acknowledgements, payload bytes."""
    bare = (F.octet_length("payload") == 0) & (F.col("flags").bitwiseAND(31) == 16)
    # Keys of metrics.
    return {f"{prefix}.segment.accepted": ~bare, "capture.segment.skipped.pureAck": bare}, {f"{prefix}.byteStream.bytes": F.when(F.octet_length("payload") > 0, F.octet_length("payload"))}


def assembler_metrics(prefix: str = "live") -> tuple[dict[str, Column], dict[str, Column]]:
    """The same of ``reassembly.outcomes``: what became of each segment, by side."""
    counts, measures = {}, {}
    for side, own in (("client", F.col("from_client")), ("server", ~F.col("from_client"))):
        # Keys of metrics.
        for outcome in ("duplicate", "stored", "buffered", "contiguous"):
            counts[f"{prefix}.flowAssembler.{side}.{outcome}"] = own & F.col(outcome)
        measures[f"{prefix}.flowAssembler.{side}.bytes"] = F.when(own & F.col("contiguous"), F.col("n_bytes"))
    return counts, measures


def merged(values: list[dict]) -> dict:
    """Counts and histograms of several batches as those of all: counts add up; so do a histogram's numbers and totals, and its ends are the outmost."""
    out: dict = {}
    for one in values:
        for key, v in one.items():
            have, v = out.get(key), v.asDict() if isinstance(v, Row) else v
            if not isinstance(v, dict):
                out[key] = (have or 0) + v
            elif v["n"]:
                out[key] = v if not have or not have["n"] else {"n": have["n"] + v["n"], "total": have["total"] + v["total"], "least": min(have["least"], v["least"]), "most": max(have["most"], v["most"])}
            else:
                out.setdefault(key, v)
    return out


class Totals(StreamingQueryListener):
    """Observed metrics of running streams by the name they were observed under, added up over batches; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: dict[str, dict] = {}
        self.batches: set[tuple] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if (p.runId, p.batchId) in self.batches:
            return
        self.batches.add((p.runId, p.batchId))
        for name, row in p.observedMetrics.items():
            self.seen[name] = merged([self.seen.get(name, {}), row.asDict(recursive=True)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.batches = {b for b in self.batches if b[0] != event.runId}
