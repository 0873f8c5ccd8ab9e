"""Removal of word passages that occur in an earlier document: count-min prefilter, exact second pass.

A window is ``size`` consecutive words of one document.  The first pass counts windows in a count-min
sketch of two rows: each unit, some windows of one partition, sends its cells, deltas of sorted places, cut into slices of
the sketch.  The sketches are merged slice by slice, and each unit is answered with a bit for each of its own cells, set if it counts
two or more.  It overestimates, so a window whose two cells aren't both among them occurs once and is done with.  The second pass
groups only the others, exactly, by 96-bit hashes: each partition keeps a window's smallest document and settles the rest
of its documents itself, so that a passage in a third of all documents sends a row a partition.  The words
of a document's windows that start in a smaller document go.

The sketch grows with the input, ``BYTES_PER_CELL`` at any size, and nobody ever holds more of it than a slice:
no driver, no broadcast.  A task of the second pass reads the answers to its own units, two bits a window at
most, from the scratch folder.  A unit knows its answer by a digest of its windows; should a partition hold other
rows the second time, as after a shuffle that is dealt anew, its windows all count as repeated: slower, never wrong.

Defined cases: null text has no words; documents shorter than a window lose nothing; windows are judged
on the input; rows that share an id are one document and don't remove each other's windows;
a row with a null id stays as it is and removes nothing; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources._files import locate
from ._grouped import groups
from ._runtime import Scratch, partitions, prepare
from ._words import Words, binary, mix

ROWS = 2
#: Bytes of text to a cell, and to a slice of the sketch; a window has about 6.5.
BYTES_PER_CELL = 1.25
BYTES_PER_SLICE = 26_000_000
#: Slices at least.
SLICES = 64
#: Windows of a unit of the sketch, and estimated repeated ones that a task gathers before it sends them.
FLUSH = 1_000_000
FLUSH_REPEATED = 1_000_000


def shape_for(n_bytes: int) -> tuple[int, int]:
    """Cells of a row and slices that they are cut into, powers of two."""
    power = lambda n: 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))
    slices = max(SLICES, power(n_bytes / BYTES_PER_SLICE))
    return max(1024 * slices, power(n_bytes / BYTES_PER_CELL)), slices


def _pack_places(places: np.ndarray) -> bytes:
    """Sorted places as the byte planes of their deltas, compressed."""
    delta = np.diff(places, prepend=0)
    most = int(delta.max(initial=0))
    width = 2 if most < 1 << 16 else 4
    planes = np.ascontiguousarray(delta.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes.tobytes())


def _unpack_places(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((mix(h ^ np.uint64(0xD1B54A32D192ED03)) if row else h) & np.uint64(cells - 1)).astype(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _units(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]]]:
    """Units of ``most`` windows or a batch more: the number, and the batches (``doc_id, text``) with their words, window hashes and which windows are whole."""
    number, held, gathered = 0, 0, []
    for batch in batches:
        words = Words(binary(batch.column(1)).to_pylist())
        h, whole = words.windows(size, words.hashes())
        gathered.append((batch, words, h, whole))
        held += int(whole.sum())
        if held >= most:
            yield number, gathered
            number, held, gathered = number + 1, 0, []
    if held:
        yield number, gathered


def _digest(h: np.ndarray) -> bytes:
    return len(h).to_bytes(8, "little") + int(np.bitwise_xor.reduce(h)).to_bytes(8, "little") + int(h.sum()).to_bytes(8, "little")


#: Rows of this slice and below carry units' digests.
DIGEST = -1


def answers(docs: DataFrame, size: int, cells: int, slices: int, scratch: Scratch) -> str:
    """A folder of ``part=n`` with rows ``unit, slice, bits``: for each of a unit's cells in a slice of a row, in order, whether it counts two or more. Takes ``text``, the second column of ``docs``."""
    width = cells // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slice", "part", "unit", "once", "more"])

        for unit, gathered in _units(batches, size, FLUSH):
            h = np.concatenate([h[whole] for _, _, h, whole in gathered])
            rows = [(DIGEST - unit % slices, part, unit, _digest(h), None)]
            for row in range(ROWS):
                places, counts = np.unique(_cells(h, row, cells), return_counts=True)
                cut = np.searchsorted(places, np.arange(slices + 1) * width)
                for s in np.flatnonzero(np.diff(cut)):
                    at, n = places[cut[s] : cut[s + 1]] - s * width, counts[cut[s] : cut[s + 1]]
                    rows.append((row * slices + int(s), part, unit, _pack_places(at), _pack_places(np.flatnonzero(n > 1))))
                    if len(rows) >= 64:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["slice"]):
            s, part, unit, once, more = (g.column(c).to_pylist() for c in ("slice", "part", "unit", "once", "more"))
            if s[0] <= DIGEST:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(unit, pa.int64()), pa.array([DIGEST] * len(part), pa.int64()), pa.array(once, pa.binary())], names=["part", "unit", "slice", "bits"])
                continue
            lists = [_unpack_places(x) for x in once]
            several = [x[_unpack_places(y)] for x, y in zip(lists, more, strict=True)]
            every = np.sort(np.concatenate(lists))
            repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *several]))
            mine = [_among(x, repeated) for x in lists]
            keep = [k for k, x in enumerate(mine) if x.any()]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([part[k] for k in keep], pa.int64()), pa.array([unit[k] for k in keep], pa.int64()), pa.array([s[0]] * len(keep), pa.int64()), pa.array([np.packbits(mine[k]).tobytes() for k in keep], pa.binary())], names=["part", "unit", "slice", "bits"])

    n = partitions(docs.sparkSession)
    counted = docs.mapInArrow(count, "slice long, part long, unit long, once binary, more binary")
    merged = counted.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(merge, "part long, unit long, slice long, bits binary")
    path = scratch.path()
    merged.repartition(n, "part").write.partitionBy("part").parquet(path)
    return path


class Answers:
    """The answers to one partition's units."""

    def __init__(self, path: str, part: int, cells: int, slices: int):
        store, base = locate(path)
        self.digests: dict[int, bytes] = {}
        self.bits: dict[tuple[int, int], bytes] = {}
        self.width, self.slices, self.cells = cells // slices, slices, cells
        for f in store.get_file_info(fs.FileSelector(f"{base}/part={part}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                for unit, s, bits in zip(*(c.to_pylist() for c in pq.read_table(f.path, filesystem=store, columns=["unit", "slice", "bits"], partitioning=None).columns), strict=True):
                    if s == DIGEST:
                        self.digests[unit] = bits
                    else:
                        self.bits[unit, s] = bits

    def repeated(self, unit: int, h: np.ndarray) -> np.ndarray:
        """Which of the unit's windows are estimated repeated."""
        if self.digests.get(unit) != _digest(h):
            return np.ones(len(h), dtype=bool)
        mask = np.ones(len(h), dtype=bool)
        for row in range(ROWS):
            places, at = np.unique(_cells(h, row, self.cells), return_inverse=True)
            cut = np.searchsorted(places, np.arange(self.slices + 1) * self.width)
            more = np.zeros(len(places), dtype=bool)
            for s in range(self.slices):
                if (bits := self.bits.get((unit, row * self.slices + s))) is not None:
                    more[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=cut[s + 1] - cut[s])
            mask &= more[at]
        return mask


def _first_documents(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by window and document: the order, which rows begin a window, which belong to a larger document than its first."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else doc
    return order, new, doc > first


def _id_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    """``pmod(xxhash64(id), n)`` as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotate = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    x = np.full(len(ids), 42 + 8, dtype=np.uint64) + p5
    x ^= rotate(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    x = rotate(x, 27) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return (x ^ (x >> np.uint64(32))).view(np.int64) % n


def repeated_windows(docs: DataFrame, size: int, answered: str, cells: int, slices: int, id_buckets: int) -> DataFrame:
    """``bucket, h, d``: windows that a smaller document also has, packed many to a row: their hashes and documents as
    little-endian 64-bit integers, the documents those of one bucket of ids."""
    spark = docs.sparkSession
    buckets = max(64, 4 * partitions(spark))

    def by_id(doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = _id_buckets(doc, id_buckets)
        order = np.argsort(bucket, kind="stable")
        doc, h, cut = doc[order], h[order], np.searchsorted(bucket[order], np.arange(id_buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            x = slice(cut[b], cut[b + 1])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([h[x].astype("<u8").tobytes()]), pa.nulls(1, pa.binary()), pa.array([doc[x].astype("<i8").tobytes()])], names=["bucket", "h", "g", "d"])

    def send(gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, g, doc = (np.concatenate(x) for x in zip(*gathered, strict=True))
        order, new, later = _first_documents(h, g, doc)
        h, g, doc = h[order], g[order], doc[order]
        yield from by_id(doc[later], h[later])  # settled here, told by the lack of g
        h, g, doc = h[new], g[new], doc[new]  # sorted by h, so a bucket of leading bits is a slice
        cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            x = slice(cut[b], cut[b + 1])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([v[x].astype(t).tobytes()]) for v, t in ((h, "<u8"), (g, "<u4"), (doc, "<i8")))], names=["bucket", "h", "g", "d"])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Answers(answered, TaskContext.get().partitionId(), cells, slices)
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for unit, parts in _units(batches, size, FLUSH):
            repeated = known.repeated(unit, np.concatenate([h[whole] for _, _, h, whole in parts]))
            at = 0
            for batch, words, h, whole in parts:
                n = int(whole.sum())
                ids = batch.column(0)
                take = np.flatnonzero(whole)[repeated[at : at + n]]
                at += n
                if ids.null_count:
                    take = take[~ids.is_null().to_numpy(zero_copy_only=False)[words.document()[take]]]
                if len(take):
                    g, _ = words.windows(size, words.hashes(1), 1)
                    gathered.append((h[take], g[take].astype(np.uint32), ids.fill_null(0).to_numpy()[words.document()[take]]))
                    held += len(take)
            if held >= FLUSH_REPEATED:
                yield from send(gathered)
                gathered, held = [], 0
        if held:
            yield from send(gathered)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, of which one is held at a time."""
        current, parts = None, []
        gone: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for out in by_id(*(np.concatenate(x) for x in zip(*gone, strict=True))):
                yield out.select(["bucket", "h", "d"])

        def settle(doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal gone, held
            gone.append((doc, h))
            held += len(doc)
            if held >= FLUSH_REPEATED:
                yield from flush()
                gone, held = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            h, g, doc = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*parts, strict=True), ("<u8", "<u4", "<i8"), strict=True))
            order, _, later = _first_documents(h, g, doc)
            yield from settle(doc[order][later], h[order][later])

        for batch in batches:
            for b, h, g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g is None:
                    yield from settle(np.frombuffer(d, dtype="<i8"), np.frombuffer(h, dtype="<u8"))
                    continue
                if b != current and parts:
                    yield from close()
                    parts = []
                current = b
                parts.append((h, g, d))
        if parts:
            yield from close()
        if held:
            yield from flush()

    sent = docs.mapInArrow(estimate, "bucket int, h binary, g binary, d binary")
    return sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(group, "bucket int, h binary, d binary")


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """The columns of ``docs``, the text without its repeats, and ``n_words``, ``n_removed``.

    Reads tables of ``scratch``. Columns of ``docs`` that are named like the two are replaced.  A text that loses words has the others joined by single spaces; a text that loses none stays as it is.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cells, slices = shape_for(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    answered = answers(plain, size, cells, slices, scratch)
    n = partitions(spark)
    id_buckets = 3 * n
    windows = repeated_windows(plain, size, answered, cells, slices, id_buckets)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each bucket of ids the windows come first, then the documents that they cover."""
        bucket, gone = None, {}
        for batch in batches:
            keys, order, h, d = (batch.column(c) for c in range(4))
            is_doc = order.to_numpy() == 1
            keys = keys.to_numpy()
            begins = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
            for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
                if keys[a] != bucket:
                    bucket, gone = keys[a], {}
                rows = slice(a, b)
                for k in np.flatnonzero(~is_doc[rows]) + a:
                    doc, hashes = np.frombuffer(d[int(k)].as_py(), dtype="<i8"), np.frombuffer(h[int(k)].as_py(), dtype="<u8")
                    at = np.argsort(doc, kind="stable")
                    doc, hashes = doc[at], hashes[at]
                    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    for i, own in zip(doc[cut].tolist(), np.split(hashes, cut[1:]), strict=True):
                        gone.setdefault(i, []).append(own)
                first = a + int((~is_doc[rows]).sum())
                if first < b:
                    yield _covered(batch.slice(first, b - first), gone)

    def _covered(batch: pa.RecordBatch, gone: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        texts = binary(batch.column(5)).to_pylist()
        words = Words(texts)
        h, whole = words.windows(size, words.hashes())
        removed, kept = [], []
        for i, doc in enumerate(batch.column(4).to_pylist()):
            a, b = words.first[i], words.first[i + 1]
            removed.append(0)
            kept.append(texts[i])
            if doc in gone:
                edge = np.zeros(b - a + 1, dtype=np.int64)
                at = np.flatnonzero(np.isin(h[a:b], np.concatenate(gone[doc])) & whole[a:b])
                edge[at] += 1
                edge[at + size] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                removed[-1] = int(b - a - stay.sum())
                if removed[-1]:
                    kept[-1] = b" ".join(w for w, k in zip(texts[i].split(), stay, strict=True) if k)
        return pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary(), mask=batch.column(5).is_null().to_numpy(zero_copy_only=False)).cast(pa.string())], names=[*batch.schema.names[6:], "n_words", "n_removed", "kept_text"])

    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = [n for c, n in zip(docs.columns, names, strict=True) if c != text_col]
    own = F.col(id_col).cast("long")
    bucket = F.pmod(F.xxhash64(F.coalesce(own, F.xxhash64(text_col))), F.lit(id_buckets)).cast("int")
    nothing = F.lit(None).cast("binary")
    held = docs.select(bucket.alias("bucket"), F.lit(1).alias("order"), nothing.alias("h"), nothing.alias("d"), own.alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True) if c != text_col))
    kinds = {f.name: f.dataType for f in held.schema}
    packed = windows.select("bucket", F.lit(0).alias("order"), "h", "d", F.lit(None).cast("long"), F.lit(None).cast("string"), *(F.lit(None).cast(kinds[n]) for n in rest))
    both = held.union(packed).repartition(n, "bucket").sortWithinPartitions("bucket", "order")
    out = both.mapInArrow(cover, ", ".join([*(f"{n} {kinds[n].simpleString()}" for n in rest), "n_words long, n_removed long, kept_text string"]))
    cols = [F.col("kept_text" if c == text_col else n).alias(c) for c, n in zip(docs.columns, names, strict=True)]
    return out.select(*cols, "n_words", "n_removed")
