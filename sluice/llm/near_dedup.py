"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles, the weight being how often a shingle
occurs.  ProbMinHash lets every shingle arrive as a Poisson process whose rate is its weight; each
arrival falls into one of ``bands * rows`` registers, a register keeps the shingle that came first,
and a document stops as soon as no later arrival can still be first anywhere.  Two documents agree
in a register with the probability Jaccard similarity of their weighted sets, which is the plain
Jaccard similarity if no shingle repeats.

Documents that agree in all rows of a band meet in a bucket.  Buckets with the same members count
once, and in each block of one a breadth-first search over exactly computed similarities gives links that connect what
is similar, never all pairs.  Exact copies are one node from the start.  Distributed connected components make the classes.

A bucket beyond a block's size is searched twice.  First each member goes to one block, and a few hubs go to all, which
mostly connects the bucket.  Then the members outside of its largest component are dealt into blocks that meet
each block of all members, so that no link but those inside one component goes unsearched.  A bucket of n near copies of
one text costs n rows and not the square of its blocks; only one of n texts unlike each other does.

Defined cases: null text counts as empty; a document without words is a class of its own; one of
fewer than five words has one shingle of all its words; a null id is never linked and is kept; rows
that share an id are one document (one row in the result); ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._grouped import groups
from ._runtime import Scratch, finished, partitions, prepare
from ._words import Words, binary, mix, powers

#: Documents and shingles that one block of a bucket may hold.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 4_000_000
#: Members of a large bucket that go to all of its blocks, about.
HUBS = 8
_GOLDEN = 0x9E3779B97F4A7C15


def weighted_shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """Document number, hash and count of each distinct shingle, sorted by both; the words and their hashes."""
    words = Words(texts)
    hashes = words.hashes()
    window, whole = words.windows(size, hashes)
    doc = words.document()
    lengths = np.diff(words.first)
    d, h = doc[whole], window[whole]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        few = [mix(np.asarray([np.sum(hashes[words.first[i] : words.first[i + 1]] * powers(size, 0)[: lengths[i]])], dtype=np.uint64) + np.uint64(lengths[i])) for i in short]
        d, h = np.concatenate((d, short)), np.concatenate((h, *few))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.concatenate((at, [len(d)]))), words, hashes


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register, for each document (0 where there is none)."""
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, dtype=np.uint64)
    active = np.arange(len(doc))
    time = np.zeros(len(doc))
    turn = 0
    while len(active):
        seed = mix(shingle[active] + np.uint64((_GOLDEN * (2 * turn + 1)) % 2**64))
        time += -np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[active]
        latest = first.reshape(n_docs, registers).max(axis=1)
        early = time < latest[doc[active]]  # the rest can't come first any more
        active, time, seed = active[early], time[early], seed[early]
        place = doc[active] * registers + (mix(seed ^ np.uint64(_GOLDEN)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        ahead = first[place] == time
        winner[place[ahead]] = shingle[active[ahead]]
        turn += 1
    return winner.reshape(n_docs, registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(winners), bands), dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(_GOLDEN) + winners.reshape(-1, bands, rows)[:, :, r])
    return mix(keys + np.arange(bands, dtype=np.uint64))


def probability_jaccards(y: np.ndarray, a: np.ndarray, b: np.ndarray, total_a: float, total_b: np.ndarray) -> np.ndarray:
    """Probability Jaccard similarity of one weighted set with each of several.

    Each shared member has a row: the other set's number, its weight in the one and in the other; the totals are of all weights.
    """
    ratio = b / a
    order = np.lexsort((ratio, y))
    y, a, b, ratio = y[order], a[order], b[order], ratio[order]
    out = np.zeros(len(total_b))
    if not len(y):
        return out
    first = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    counts = np.diff(np.concatenate((first, [len(y)])))
    level = np.flatnonzero(np.concatenate(((y[1:] != y[:-1]) | (ratio[1:] != ratio[:-1]), [True])))
    last = level[np.searchsorted(level, np.arange(len(y)))]  # of those of the same set and ratio
    sums = lambda v: np.concatenate(([0.0], np.cumsum(v)))
    run_a, run_b = sums(a), sums(b)
    shared_a, shared_b = np.add.reduceat(a, first), np.add.reduceat(b, first)
    below = run_a[last + 1] - np.repeat(run_a[first], counts)
    above = np.repeat(shared_b + run_b[first], counts) - run_b[last + 1]
    only_a, only_b = np.repeat(total_a - shared_a, counts), np.repeat(total_b[y[first]] - shared_b, counts)
    out[y[first]] = np.add.reduceat(a / (only_a + only_b / ratio + below + above / ratio), first)
    return out


def linked(ids: list[int], sets: list[np.ndarray], weights: list[np.ndarray | None], threshold: float) -> list[tuple[int, int]]:
    """Links of similarity ``threshold`` or more that connect whatever such links connect; those left out lie within a component."""
    n = len(ids)
    sizes = np.asarray([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    own = np.concatenate([np.ones(s) if w is None else w.astype(float) for w, s in zip(weights, sizes, strict=True)])
    posted = np.argsort(token, kind="stable")
    holder, held = np.repeat(np.arange(n), sizes)[posted], own[posted]
    ends = np.cumsum(np.bincount(token))
    starts = np.concatenate(([0], ends[:-1]))
    heavy = np.asarray([w is not None for w in weights])
    total = np.add.reduceat(own, begin[:-1])
    left = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier and left.any():
            x = frontier.pop()
            t = token[begin[x] : begin[x + 1]]
            lengths = ends[t] - starts[t]
            runs = np.cumsum(lengths)
            at = np.arange(runs[-1]) - np.repeat(runs - lengths, lengths) + np.repeat(starts[t], lengths)
            y = holder[at]
            shared = np.bincount(y, minlength=n)
            near = left & (shared >= threshold * (sizes[x] + sizes - shared) - 1e-9)
            check = left & (shared > 0) & (heavy | heavy[x])
            if check.any():
                near &= ~check
                a, b = np.repeat(own[begin[x] : begin[x + 1]], lengths), held[at]
                # With s the sum of the smaller shares of the totals, the similarity lies between s / (2 - s) and s.
                s = np.bincount(y, np.minimum(a / total[x], b / total[y]), n)
                near |= check & (s / (2 - s) >= threshold)
                check &= ~near & (s >= threshold - 1e-9)
                some = check[y]
                near |= check & (probability_jaccards(y[some], a[some], b[some], total[x], total) >= threshold - 1e-9)
            found = np.flatnonzero(near)
            left[found] = False
            frontier.extend(found)
            out.extend((ids[x], ids[k]) for k in found)
    return out


def _blocks(rows: str, words: str) -> Column:
    """Blocks for so many members with so many words."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(words) / BLOCK_SHINGLES)).cast("int")


def _own_block() -> Column:
    return F.pmod(F.xxhash64("rep"), "parts").cast("int")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _second_round(member: DataFrame, large: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, key, blocks``: members of large buckets, those outside of the bucket's largest component dealt to meet every block."""
    placed = scratch.table(member.join(large, "key").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "parts", F.coalesce("component", "rep").alias("component")))
    main = placed.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"))
    loose = F.col("component") != F.col("main")
    rest = placed.join(main, "key").where(loose).groupBy("key").agg(F.first("main").alias("main"), F.count("*").alias("rows"), F.sum("n").alias("words")).select("key", "main", _blocks("rows", "words").alias("loose_parts"))
    meets = F.transform(_upto(F.col("loose_parts")), lambda a: (a * F.col("parts") + _own_block()).cast("long"))
    mine = (F.pmod(F.xxhash64("rep", F.lit(1)), "loose_parts") * F.col("parts")).cast("long")
    return placed.join(rest, "key").select("rep", "key", F.when(loose, F.array_union(meets, F.transform(_upto(F.col("parts")), lambda b: mine + b))).otherwise(meets).alias("blocks"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bands: int = 20, rows: int = 4) -> DataFrame:
    """``doc_id, class_id, kept`` with a row for each document; the class's smallest id is its class_id and is kept.

    Reads tables of ``scratch``. With 20 bands of 4 rows a pair of similarity 0.8 misses all buckets once in 40,000 times.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(1)).to_pylist()
            d, h, w, words, hashes = weighted_shingles(texts, shingle)
            keys = band_keys(prob_minhash(d, h, w, len(texts), bands * rows), bands, rows)
            counts = np.diff(words.first)
            place = np.arange(len(hashes)) - np.repeat(words.first[:-1], counts)
            some = counts > 0
            sums = []
            for which, each in enumerate((hashes, words.hashes(1))):
                value = np.zeros(len(texts), dtype=np.uint64)
                if some.any():
                    value[some] = np.add.reduceat(each * powers(int(counts.max()), which)[place], words.first[:-1][some])
                sums.append(pa.array(mix(value).view(np.int64), mask=~some))
            flat = pa.array(keys[some].view(np.int64).ravel())
            offsets = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "h1", "h2", "n", "keys"])

    signed = scratch.table(base.mapInArrow(signatures, "doc_id long, h1 long, h2 long, n long, keys array<long>"))
    texts = scratch.table(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    member = texts.select("rep", "n", F.explode("keys").alias("key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("words"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("x2")).where("size > 1")
    kept = scratch.table(buckets.groupBy("size", "words", "x1", "x2").agg(F.min("key").alias("key")).select("key", "size", _blocks("size", "words").alias("parts")))
    hub = F.pmod(F.xxhash64("key", "rep"), "size") < HUBS
    first = member.join(kept, "key").select("rep", "key", F.when(hub, _upto(F.col("parts"))).otherwise(F.array(_own_block())).alias("blocks"))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            d, h, w, _, _ = weighted_shingles(binary(batch.column(1)).to_pylist(), shingle)
            cut = np.searchsorted(d, np.arange(len(ids) + 1))
            rows = []
            for i, places in enumerate(batch.column(2).to_pylist()):
                a, b = cut[i], cut[i + 1]
                counts = w[a:b].astype("<u4").tobytes() if w[a:b].max(initial=1) > 1 else None
                mine = h[a:b].astype("<u8").tobytes()
                for p in places:
                    rows.extend((p["key"], block, ids[i], mine, counts) for block in p["blocks"])
                    if len(rows) >= 256:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "block", "id", "shingles", "weights"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "block"]):
            ids = group.column("id").to_pylist()
            one = {i: k for k, i in enumerate(ids)}  # rows that repeat an id count once
            sets = group.column("shingles").to_pylist()
            weights = group.column("weights").to_pylist()
            at = list(one.values())
            if len(at) < 2:
                continue
            edges = linked([ids[k] for k in at], [np.frombuffer(sets[k], dtype="<u8") for k in at], [None if weights[k] is None else np.frombuffer(weights[k], dtype="<u4") for k in at], threshold)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def links(dealt: DataFrame) -> DataFrame:
        """Links within the blocks ``rep, key, blocks`` deals the documents to."""
        wanted = dealt.groupBy("rep").agg(F.collect_list(F.struct("key", "blocks")).alias("buckets"))
        rows = base.join(wanted, base.doc_id == wanted.rep).select("doc_id", "text", "buckets").mapInArrow(payload, "key long, block long, id long, shingles binary, weights binary")
        return rows.repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block").mapInArrow(search, "a long, b long")

    component = connected_components(links(first), scratch)
    large = kept.where("parts > 1")
    if not large.isEmpty():
        further = scratch.table(links(scratch.table(_second_round(member, large, component, scratch))))
        if not further.isEmpty():
            component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(further), scratch)
    classes = scratch.table(texts.select("h1", "h2", "rep").join(component, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_id")))
    found = signed.where("n > 0").select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id").union(signed.where("n = 0").select("doc_id", F.col("doc_id")))
    one = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    nulls = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return one.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")).union(nulls)


def without_near_duplicates(docs: DataFrame, keep: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their columns as they are. Reads a table of ``keep``."""
    scratch = Scratch(docs.sparkSession)
    gone = finished(near_duplicates(docs, scratch, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("gone_id")), scratch, keep)
    return docs.join(gone, docs[id_col] == gone.gone_id, "left_anti")
