"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of a label are one node with a count.  In each table a node's key is its label and the signs of
its projections on the table's hyperplanes.  Only ids and signs go to the buckets.  There a pair is a suspect if
its signs over all tables differ in no more bits than those of a pair at the threshold do, but for one in 10^6; a pair that
meets in several tables counts in the first.  Vectors are sent once more only to those blocks in which they
have a suspect, and their cosines are computed exactly, as matrix products.  Buckets beyond a block's size are dealt
into pairs of blocks.  Blocks give numbers of links and a spanning forest of links, never pairs.

``tables`` and ``bits`` follow the number of vectors of the largest label: a bucket holds about ``BUCKET`` unrelated ones
at any size, and a pair at the threshold misses all tables with probability ``MISS`` at most.  A group of very many
near-identical, unequal vectors costs the square of its size in arithmetic, since their links are to be
counted, dealt over blocks of bounded size.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link
with nothing and are kept; rows with a null id too; vectors of different lengths never link; rows that share an id
count as vectors of their own; other columns aren't read; no vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._grouped import groups
from ._runtime import Scratch, partitions, prepare
from ._words import mix

BLOCK_ROWS = 512
BUCKET = 64
MISS = 1e-5
SEED = 7


#: Probability that a pair at the threshold that meets is no suspect.
UNSEEN = 1e-6


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors."""
    bits = min(48, max(6, math.ceil(math.log2(max(1, n) / BUCKET))))
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-meet)))


def most_differing(bits: int, threshold: float) -> int:
    """Bits in which the signs of a pair at the threshold differ at most, but for a probability of ``UNSEEN``."""
    differ = math.acos(min(1.0, threshold)) / math.pi
    tail, k = 1.0, -1
    while tail > UNSEEN and k < bits:
        k += 1
        tail -= math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k)
    return k


def signs_of(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The sign bit of each projection, table by table."""
    planes = np.random.Generator(np.random.PCG64([SEED, bits, tables, vectors.shape[1]])).standard_normal((vectors.shape[1], bits * tables))
    return vectors @ planes > 0


def _codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return (signs.reshape(len(signs), tables, bits) * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _words(raw: list[bytes]) -> np.ndarray:
    """Packed signs as rows of 64-bit words."""
    return np.frombuffer(b"".join(raw), dtype="<u8").reshape(len(raw), -1)


def _unsigned(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=bits * tables, bitorder="little")
    return _codes(signs, bits, tables)


def _place(x: int, y: int, part: int, t: int) -> int:
    """Table, blocks and own part in one integer: 18 bits each but for the table."""
    return t << 54 | x << 36 | y << 18 | part


def _parts(parts: Column) -> Column:
    """The number of a bucket's blocks, an error where ``_place`` has no room for it."""
    return F.when(parts < 1 << 18, parts).otherwise(F.raise_error(F.concat(F.lit("a bucket of more than 262143 blocks: "), parts.cast("string"))))


def _usable(vector) -> np.ndarray | None:
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def _pack(v: np.ndarray) -> bytes:
    """Components as 4-byte floats where that loses nothing, else as 8-byte ones, after a byte that tells which."""
    with np.errstate(over="ignore"):
        small = v.astype("<f4")
    return b"4" + small.tobytes() if np.array_equal(small.astype(np.float64), v) else b"8" + v.astype("<f8").tobytes()


def _unpack(raw: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as rows in double precision."""
    return np.stack([np.frombuffer(r, dtype="<f4" if r[:1] == b"4" else "<f8", offset=1).astype(np.float64) for r in raw])


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // int(raw[:1])


def near_embeddings(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row. Reads tables of ``scratch``."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_usable(v) for v in batch.column(1).to_pylist()]
            labels = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None or label is None or i is None else _pack(v) for v, label, i in zip(out, labels, ids, strict=True)], pa.binary()), batch.column(2)], names=["vec_id", "vector", "label"])

    known = scratch.table(rows.mapInArrow(nodes, "vec_id long, vector binary, label string").select("vec_id", "label", "vector", F.xxhash64("vector", "label").alias("h1"), F.md5("vector").alias("h2")))
    usable = known.where("vector IS NOT NULL")
    node = scratch.table(usable.groupBy("h1", "h2", "label").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("vector").alias("vector")))
    bits, tables = plan(node.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)
    differ = most_differing(bits * tables, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys = np.zeros((len(raw), tables), dtype=np.uint64)
            packed: list[bytes] = [b""] * len(raw)
            lengths = [_length(v) for v in raw]
            for length in set(lengths):
                at = [i for i, n in enumerate(lengths) if n == length]
                signs = signs_of(_unpack([raw[i] for i in at]), bits, tables)
                own = _codes(signs, bits, tables).astype(np.uint64) * np.uint64(64) + np.arange(tables, dtype=np.uint64)
                keys[at] = mix(own ^ mix(np.asarray([length], dtype=np.uint64)))
                rows = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1, bitorder="little")
                for i, row in zip(at, rows, strict=True):
                    packed[i] = row.tobytes()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * tables), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat, pa.array(packed, pa.binary())], names=["id", "label", "keys", "signs"])

    coded = scratch.table(node.select("id", "vector", "label").mapInArrow(keyed, "id long, label string, keys array<long>, signs binary"))
    member = coded.select("id", "signs", F.posexplode("keys").alias("t", "key"), "label").select("id", "signs", "t", F.xxhash64("key", "label").alias("key"))
    large = scratch.table(member.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select("key", _parts(F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("parts")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member to the pairs of blocks that its part is in."""

        def send(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "place", "id", "signs"])

        for batch in batches:
            out = []
            for key, t, parts, i, signs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = int(mix(np.asarray([i % 2**64], dtype=np.uint64))[0]) % parts if parts else 0
                out.extend((key, _place(min(c, o), max(c, o), c, t), i, signs) for o in range(parts or 1))
                if len(out) >= 1024:
                    yield send(out)
                    out = []
            if out:
                yield send(out)

    def blocks(dealt: DataFrame) -> DataFrame:
        block = F.shiftrightunsigned("place", 18)
        return dealt.withColumn("block", block).repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block")

    def sides(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The rows to compare, and whether they are the same ones."""
        x, y, part = place[0] >> 36 & 0x3FFFF, place[0] >> 18 & 0x3FFFF, place & 0x3FFFF
        everyone = np.arange(len(place))
        return (everyone, everyone, True) if x == y else (np.flatnonzero(part == x), np.flatnonzero(part == y), False)

    def first_met(i: np.ndarray, j: np.ndarray, words: np.ndarray, ids: np.ndarray, t: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, each once, that no table before ``t`` has."""
        take = ids[i] < ids[j] if same else ids[i] != ids[j]
        i, j = i[take], j[take]
        if len(i) and t:
            some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            codes = _unsigned(words[some], bits, tables)
            new = (codes[at[: len(i)], :t] != codes[at[len(i) :], :t]).all(axis=1)
            i, j = i[new], j[new]
        return i, j

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``id, key, place`` of the members that have a suspect in their block."""
        for g in groups(batches, ["key", "block"]):
            if g.num_rows < 2:
                continue
            place, ids = g.column("place").to_numpy(), g.column("id").to_numpy()
            words = _words(g.column("signs").to_pylist())
            a, b, same = sides(place)
            distance = sum(np.bitwise_count(words[a, None, w] ^ words[None, b, w]).astype(np.uint16) for w in range(words.shape[1]))
            i, j = np.nonzero(distance <= differ)
            i, j = first_met(a[i], b[j], words, ids, int(place[0] >> 54), same)
            if len(i):
                at = np.unique(np.concatenate((i, j)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), g.column("key")[0].as_py(), dtype=np.int64)), pa.array(place[at])], names=["id", "key", "place"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "block"]):
            place, ids, size = (g.column(c).to_numpy() for c in ("place", "id", "size"))
            v = _unpack(g.column("vector").to_pylist())
            scale = np.abs(v).max(axis=1, keepdims=True)
            v = v / scale
            v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            a, b, same = sides(place)
            i, j = np.nonzero(v[a] @ v[b].T >= threshold)
            i, j = first_met(a[i], b[j], _words(g.column("signs").to_pylist()), ids, int(place[0] >> 54), same)
            if not len(i):
                continue
            links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
            root = list(range(len(ids)))
            edges = []
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                while root[q] != q:
                    root[q] = root[root[q]]
                    q = root[q]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((ids[p], ids[q]))
            at = np.flatnonzero(links)
            x = np.concatenate((ids[at], np.asarray([e[0] for e in edges], dtype=np.int64)))
            y = np.concatenate((links[at].astype(np.int64), np.asarray([e[1] for e in edges], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) >= len(at)), pa.array(x), pa.array(y)], names=["edge", "a", "b"])

    dealt = member.join(large, "key", "left").select("key", "t", "parts", "id", "signs").mapInArrow(deal, "key long, place long, id long, signs binary")
    suspects = scratch.table(blocks(dealt).mapInArrow(suspect, "id long, key long, place long"))
    full = suspects.join(node.select("id", "size", "vector"), "id").join(coded.select("id", "signs"), "id")
    found = scratch.table(blocks(full).mapInArrow(search, "edge boolean, a long, b long"))
    links = found.where("NOT edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    component = connected_components(found.where("edge").select("a", "b"), scratch)
    classes = scratch.table(node.select("h1", "h2", "label", "id", "size").join(links, "id", "left").join(component, F.col("id") == F.col("node"), "left").select("h1", "h2", "label", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    good = usable.select("vec_id", "h1", "h2", "label").join(classes, ["h1", "h2", "label"]).select("vec_id", "n_links", "component_id")
    rest = known.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
