"""Token ids in bit-plane shuffled files.

File format, little-endian (version 1), one file for a run of documents in ascending id order:

    "BPS1" | u8 width: planes of an id | u32 ids to a block | u64 documents | u64 ids
    documents: i64 id and u64 number of ids of each, zstandard-compressed, after its u32 length
    chunk index: u32 count, then for each chunk u64 place in the file and u32 blocks
    chunks: for each plane u32 compressed length and a zstandard frame

A block's ids, padded with zeros, are transposed into byte planes (all lowest bytes, then the next ones;
``planes="bit"`` transposes single bits); a chunk is a number of blocks and holds each plane as a
frame of its own, so high planes, which are nearly constant, almost vanish.  A chunk can be read alone by the index.

Tasks write the files into a shared folder, each whole under its own name, and a manifest, a small table of
``part, file_no, ahead, n_tokens, name`` (ahead: the ids of the part's files before), names those that count; a task that
runs again after its executor was lost leaves a file that no manifest names.  The folder has to be a store that Arrow opens
(a path, or ``file``, ``hdfs``, ``s3``, ``gs``).

Defined cases: null text is empty and gives its end id alone; null ids come first; rows that share an id
are ordered by their text; no documents give no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources._files import locate, put
from ._runtime import partitions, prepare
from ._tokens import word_encoder
from ._words import binary

MAGIC = b"BPS1"
MANIFEST = "part int, file_no int, ahead long, n_tokens long, name string"
#: Ids after which a file is closed; a longer document makes a longer file.
FILE_IDS = 2_000_000
BLOCK_IDS = 4096
CHUNK_BLOCKS = 32
NULL_ID = -(2**63)


def shuffle_planes(ids: np.ndarray, width: int, block: int, bits: bool) -> list[bytes]:
    """``ids`` (whole blocks) as planes: plane p holds byte (or bit) p of each id, block by block."""
    if bits:
        return [np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little").tobytes() for p in range(width)]
    bytes_ = ids.astype("<u4").view(np.uint8).reshape(-1, block, 4)
    return [np.ascontiguousarray(bytes_[:, :, p]).tobytes() for p in range(width)]


def unshuffle_planes(planes: list[bytes], bits: bool) -> np.ndarray:
    out = None
    for p, plane in enumerate(planes):
        values = np.frombuffer(plane, dtype=np.uint8)
        values = (np.unpackbits(values, bitorder="little") if bits else values).astype("<u4") << np.uint32(p if bits else 8 * p)
        out = values if out is None else out | values
    return out if out is not None else np.zeros(0, dtype="<u4")


def encode_file(docs: list[tuple[int, bytes]], planes: str = "byte", level: int = 3) -> bytes:
    """One file for documents given as id and their token ids as little-endian 32-bit integers."""
    ids = np.frombuffer(b"".join(d[1] for d in docs), dtype="<u4")
    bits = planes == "bit"
    most = int(ids.max(initial=0)).bit_length()
    width = max(1, most if bits else -(-most // 8))
    table = zstandard.ZstdCompressor(level=level).compress(b"".join(struct.pack("<qQ", i, len(t) // 4) for i, t in docs))
    head = MAGIC + struct.pack("<BIQQ", width | (128 if bits else 0), BLOCK_IDS, len(docs), len(ids)) + struct.pack("<I", len(table)) + table
    step = BLOCK_IDS * CHUNK_BLOCKS
    packer, chunks = zstandard.ZstdCompressor(level=level), []
    for a in range(0, len(ids), step):
        part = ids[a : a + step]
        part = np.pad(part, (0, -len(part) % BLOCK_IDS))
        frames = [packer.compress(p) for p in shuffle_planes(part, width, BLOCK_IDS, bits)]
        chunks.append((len(part) // BLOCK_IDS, b"".join(struct.pack("<I", len(f)) + f for f in frames)))
    place = len(head) + 4 + 12 * len(chunks)
    index = struct.pack("<I", len(chunks))
    for blocks, data in chunks:
        index += struct.pack("<QI", place, blocks)
        place += len(data)
    return head + index + b"".join(data for _, data in chunks)


def decode_file(data: bytes) -> list[tuple[int, np.ndarray]]:
    """The documents of a file: id and token ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a BPS1 file")
    width, block, n_docs, n_ids = struct.unpack_from("<BIQQ", data, 4)
    bits, width = bool(width & 128), width & 127
    (size,) = struct.unpack_from("<I", data, 25)
    reader = zstandard.ZstdDecompressor()
    table = np.frombuffer(reader.decompress(data[29 : 29 + size]), dtype=[("id", "<i8"), ("n", "<u8")]) if n_docs else np.zeros(0, dtype=[("id", "<i8"), ("n", "<u8")])
    at = 29 + size
    (count,) = struct.unpack_from("<I", data, at)
    parts = []
    for c in range(count):
        place, _ = struct.unpack_from("<QI", data, at + 4 + 12 * c)
        planes = []
        for _ in range(width):
            (length,) = struct.unpack_from("<I", data, place)
            planes.append(reader.decompress(data[place + 4 : place + 4 + length]))
            place += 4 + length
        parts.append(unshuffle_planes(planes, bits))
    ids = np.concatenate(parts)[:n_ids] if parts else np.zeros(0, dtype="<u4")
    ends = np.cumsum(table["n"].astype(np.int64))
    return [(int(i), ids[b - int(n) : b]) for i, n, b in zip(table["id"], table["n"], ends, strict=True)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte") -> DataFrame:
    """Encode ``docs`` into files in ``folder``, in ascending order of ids; returns the manifest, which is kept there too."""
    spark = prepare(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        store, base = locate(folder)
        store.create_dir(base)
        context = TaskContext.get()
        part, number, ahead, held, size = context.partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{number:04d}-{context.taskAttemptId()}.bps"
            put(store, f"{base}/{name}", encode_file(held, planes))
            values = zip((part, number, ahead, size, name), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["part", "file_no", "ahead", "n_tokens", "name"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(binary(batch.column(1)).to_pylist()), strict=True):
                held.append((NULL_ID if doc is None else doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= FILE_IDS:
                    yield close()
                    number, ahead, held, size = number + 1, ahead + size, [], 0
        if held:
            yield close()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files: each document's ids as bytes, and how many ids all documents before it have."""
    spark = prepare(manifest.sparkSession)
    starts, before = [], 0
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a partition of the writer
        starts += [before] * (r["part"] + 1 - len(starts))
        before += r["n"]
    first = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("part")) + F.col("ahead")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = locate(folder)
        for batch in batches:
            for start, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    found = decode_file(f.read())
                rows = []
                for doc, ids in found:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((None if doc == NULL_ID else doc, start, len(ids), zlib.crc32(raw), raw))
                    start += len(ids)
                for i in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 1024], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    named = manifest.select(first.alias("start"), "name").repartition(partitions(spark), "name")
    return named.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
