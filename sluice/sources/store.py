"""A store of messages: blobs of their bytes and index lines that point into them, in a shared folder.

What a job writes counts once its commit is there: a table of the files of the tasks that count, in ``_commits/<job>``, which Spark's own committer
completes at once.  Readers take index files that a commit names, and those that others have put into the folder under names of
their own.  So a folder can be written to again and again, by jobs side by side, and what a failed task or job has left is never read.
No file is renamed or deleted, and no list of files comes to the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import INDEX
from ._files import locate, put

COMMITS, FILES = "_commits", "index string, blob string"
# How an index names the sides.
KINDS = {"REQUEST": "REQ", "RESPONSE": "RSP"}
PREVIEW = 16


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the complete commits, a row a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMITS}/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def _entry(line: Column) -> Column:
    """An index line's fields: of a line that is no whole JSON object, those that can be found by their names, if the side is among them; else null."""
    fields = [f.split() for f in INDEX.split(", ")]

    def found(name: str, kind: str) -> Column:
        if kind == "BIGINT":
            return F.coalesce(F.regexp_extract(line, rf'"{name}":(-?[0-9]+)', 1).try_cast("long"), F.lit(0).cast("long")).alias(name)
        text = F.regexp_extract(line, rf'"{name}":[^"]*"((?:[^"\\]|\\.)*)', 1)
        there = F.contains(line, F.lit(f'"{name}":')) & ~F.contains(line, F.lit(f'"{name}":null'))
        return F.when(there, F.regexp_replace(text, r"\\(.)", "$1")).alias(name)

    whole = F.from_json(line, f"{INDEX}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    parts = F.struct(*(found(*f) for f in fields))
    strict = F.struct(*(whole[name].alias(name) for name, _ in fields))
    known = parts["kind"].isin(*KINDS, *KINDS.values())
    return F.when(whole.isNotNull() & whole["_bad"].isNull(), strict).when(known, parts)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of ``index-*.ndjson`` with ``arrival``, in the order of jobs, files and lines; lines without a side and files without a commit are dropped."""
    lines = spark.read.text(f"{folder}/index-*.ndjson").where("trim(value) <> ''")
    lines = lines.select(_entry(F.col("value")).alias("e"), F.col("_metadata.file_name").alias("_file"), F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("arrival"))
    lines = lines.where("e IS NOT NULL").select("e.*", "_file", "arrival")
    jobs = committed(spark, folder)
    files = spark.read.schema(FILES).parquet(*jobs) if jobs else spark.createDataFrame([], FILES)
    counted = lines.join(files.select(F.col("index").alias("_file")), "_file", "left_semi").unionByName(lines.where(~F.startswith("_file", F.lit("index-job_"))))
    kind = F.coalesce(*(F.when(F.col("kind") == short, long) for long, short in KINDS.items()), "kind")
    return counted.withColumn("kind", kind).drop("_file")


def with_blobs(index: DataFrame, folder: str) -> DataFrame:
    """Adds ``headers`` and ``body``: the bytes that entries point to, empty where the blob is missing. Each task reads just its ranges; nothing is shuffled."""
    own = index.select("*", F.struct(*(F.col(f"{p}_{c}") for p in ("headers", "body") for c in ("blob", "off", "len"))).alias("_at"))
    names = index.columns
    position = len(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = locate(folder)
        open_files: dict[str, object] = {}

        def cut(blob: str | None, off: int | None, size: int | None) -> bytes:
            if not blob or not size or size < 0 or off is None:
                return b""
            if blob not in open_files:
                if len(open_files) > 16:
                    for f in open_files.values():
                        if f is not None:
                            f.close()
                    open_files.clear()
                try:
                    open_files[blob] = store.open_input_file(f"{base}/{blob}")
                except FileNotFoundError:
                    open_files[blob] = None
            f = open_files[blob]
            return b"" if f is None else f.read_at(size, off)

        for batch in batches:
            at = batch.column(position).to_pylist()
            parts = [pa.array([cut(*(a[f"{p}_{c}"] for c in ("blob", "off", "len"))) for a in at], pa.binary()) for p in ("headers", "body")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:position], *parts], names=[*names, "headers", "body"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "headers binary", "body binary"])
    return own.mapInArrow(work, schema)


def preview(payload: bytes) -> str:
    """The first bytes in hex, and dots if there are more."""
    return payload[:PREVIEW].hex() + ("..." if len(payload) > PREVIEW else "")


def write_store(messages: DataFrame, folder: str, roll_bytes: int = 128 << 20, job: str | None = None) -> DataFrame:
    """Messages (``flow_id, ord, type, data, ts_us, tx_id, src, dst, protocol``) as blobs and index lines; gives the job's files, ``index, blob``.

    Each task fills blobs of its own, a new one before a message would exceed ``roll_bytes``.  All are named after the job, by default one
    whose name sorts by time; of a ``job`` that has its commit already nothing is written again.
    """
    spark = messages.sparkSession
    job = job or f"{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    commit = f"{folder}/{COMMITS}/{job}"
    if not any(c.rsplit("/", 1)[-1] == job for c in committed(spark, folder)):
        ordered = messages.repartition("flow_id").sortWithinPartitions("flow_id", "ord").select("flow_id", "type", "data", "ts_us", "tx_id", "src", "dst", "protocol")
        ordered.mapInArrow(_blobs(folder, job, roll_bytes), FILES).write.mode("overwrite").parquet(commit)
    return spark.read.schema(FILES).parquet(commit)


def _blobs(folder: str, job: str, roll_bytes: int):
    """What a task does with its messages: blobs and index files, a row for both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = locate(folder)
        store.create_dir(base)
        context = TaskContext.get()
        stem = f"job_{job}-{context.partitionId():05d}-{context.taskAttemptId()}"
        number, data, lines = 0, bytearray(), []

        def close() -> pa.RecordBatch:
            names = f"index-{stem}-{number:04d}.ndjson", f"blob-{stem}-{number:04d}.seg"
            put(store, f"{base}/{names[1]}", bytes(data))
            put(store, f"{base}/{names[0]}", "".join(f"{x}\n" for x in lines).encode())
            return pa.RecordBatch.from_arrays([pa.array([n]) for n in names], names=["index", "blob"])

        for batch in batches:
            for flow, kind, payload, ts, tx, src, dst, protocol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = payload or b""
                if data and len(data) + len(payload) > roll_bytes:
                    yield close()
                    number, data, lines = number + 1, bytearray(), []
                end = payload.find(b"\r\n\r\n") + 4 if protocol == "HTTP" else 0
                head = end if end >= 4 else len(payload) if protocol == "HTTP" else 0
                first = payload[:head].split(b"\n")[0].decode("latin-1").strip() if protocol == "HTTP" else preview(payload)
                blob, off = f"blob-{stem}-{number:04d}.seg", len(data)
                entry = {"id": tx, "kind": KINDS.get(kind, kind), "ts_first": ts, "ts_last": ts, "session": flow, "src": src, "dst": dst, "first_line": first}
                entry |= {"headers_blob": blob, "headers_off": off, "headers_len": head, "body_blob": blob, "body_off": off + head, "body_len": len(payload) - head}
                lines.append(json.dumps({k: v for k, v in entry.items() if v is not None}, ensure_ascii=False))
                data += payload
        if lines:
            yield close()

    return work


def store_stream(messages: DataFrame, folder: str, name: str, roll_bytes: int = 128 << 20) -> DataStreamWriter:
    """A stream of messages to the store, a job a batch: a batch that runs again after a failure is written once.  ``name`` is the stream's, the same at each start."""
    return messages.writeStream.foreachBatch(lambda batch, number: write_store(batch, folder, roll_bytes, f"{name}_{number:012d}"))


def index_lines(messages: DataFrame, blob: str, fields_end: Column) -> DataFrame:
    """Index entries and the places of their bytes in one blob: headers, then body, in order of ``ord``.

    Offsets are a running sum by flow, so each flow has a blob of its own, named after it.
    """
    size = F.octet_length("data").cast("long")
    head = F.when(fields_end > 0, fields_end).otherwise(0).cast("long")
    off = F.coalesce(F.sum(size).over(W.partitionBy("flow_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    name = F.concat(F.lit(blob + "-"), F.substring(F.sha2("flow_id", 256), 1, 16), F.lit(".seg"))
    return messages.select(F.col("tx_id").alias("id"), F.col("type").alias("kind"), F.col("ts_us").alias("ts_first"), F.col("ts_us").alias("ts_last"), F.col("flow_id").alias("session"), name.alias("headers_blob"), off.alias("headers_off"), head.alias("headers_len"), name.alias("body_blob"), (off + head).alias("body_off"), (size - head).alias("body_len"))
