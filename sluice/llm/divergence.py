"""How far sources of a language differ in their use of terms, exactly.

A term is a run of ASCII letters and characters beyond ASCII, A to Z in lower case.  A language keeps the V terms that at least
``min_docs`` of its documents hold.  A source with N occurrences of kept terms gives a term with ``count`` of them
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and so does the language as a whole.  Two such values p and q of a term differ by
f = floor((p - q)^2 / (p + q)); two sources by the sum of f over all kept terms; a source's own terms are those with p above the language's.

Terms with the same counts in the same sources have the same f everywhere, so terms are grouped by that sparse vector of counts, and
every pair of sources is evaluated once for each distinct vector, times the number of its terms.  A source outside a vector
has the same p, written z, for all terms it lacks, which leaves three sums of integers:

* V f(z_s, z_t), as if no term occurred in either source;
* for each source s and each of its distinct counts, h terms: h (f(p_s, z_t) - f(z_s, z_t));
* for each distinct vector and each pair of sources in it, m terms: m (f(p_s, p_t) - f(p_s, z_t) - f(z_s, p_t) + f(z_s, z_t)).

So a rare term costs the square of the sources that have it and not of all.  Own terms are ranked by vector first; only the terms of vectors that can be
among a source's best are fetched and ranked themselves.

Memory: a task counts words in a table of bounded size; a vector has at most as many entries as its language has sources, whose square is the
result's size; a source's distinct counts are at most the square root of twice its words.

Defined cases: null text, language or source is empty; each row is a document, whatever its id; a group without terms is
compared all the same; a language without kept terms differs by 0; a source alone in its language has no pairs; no rows give no
rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import Scratch, prepare
from ._words import binary

#: A to Z in lower case, other ASCII but a to z as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that are split at once, in bytes of text; entries that a task's tables hold before they go out; pairs summed at once.
SLICE, ENTRIES, PAIRS = 4_000_000, 400_000, 1_000_000
ONE = 1_000_000_000
COUNTS = "lang string, source string, term binary, n long, docs long"


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    text = text.translate(_FOLD)
    begin = 0
    while len(text) - begin > SLICE:
        end = text.rfind(b" ", begin + 1, begin + SLICE)
        if end < 0:
            end = text.find(b" ", begin + SLICE)
            if end < 0:
                break
        yield text[begin:end].split()
        begin = end
    yield text[begin:].split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term; each group has a row of an empty term too."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, held) in tables.items():
                terms = [b"", *times]
                same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                columns = [pa.array(terms, pa.binary()), pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(held.__getitem__, times)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=[f.split()[0] for f in COUNTS.split(", ")])
            tables.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
                times, held = tables.setdefault((lang, source), (Counter(), Counter()))
                parts = _slices(text.as_py())
                words = next(parts)
                times.update(words)
                distinct = set(words)
                for words in parts:
                    times.update(words)
                    distinct.update(words)
                held.update(distinct)
            if sum(len(times) for times, _ in tables.values()) > ENTRIES:
                yield from out()
        yield from out()

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    partial = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(work, COUNTS)
    return partial.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals, which no count overflows; 1 where there is nothing to divide by."""
    return F.expr(f"if({total} + 2 * {kept} = 0, 1L, 1 + ({ONE} * cast({count} + 2 AS decimal(20, 0))) div cast({total} + 2 * {kept} AS decimal(20, 0)))")


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Sums:
    """Sums by language and pair of sources; a language's keys are arrays, merged when they have grown."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, s: np.ndarray, t: np.ndarray, value: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((np.minimum(s, t) << 32 | np.maximum(s, t), value))
        self.size += len(value)

    def merge(self) -> None:
        for lang, parts in self.parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, at, np.concatenate([v for _, v in parts]))
            self.parts[lang] = [(keys, sums)]
        self.size = sum(len(v) for parts in self.parts.values() for _, v in parts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for lang, [(keys, sums)] in self.parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["lang", "s", "t", "value"])
        self.parts, self.size = {}, 0

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > PAIRS:
            self.merge()
            if self.size > PAIRS // 2:
                yield from self.batches()


def _entries(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat values of an array of structs."""
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(lengths))), [flat.field(flat.type.get_field_index(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def _pairs_in_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The third sum, of rows ``lang, m, v array<struct<idx, p, z>>``."""
    sums = _Sums()
    for batch in batches:
        at, (idx, p, z) = _entries(batch.column(2), "idx", "p", "z")
        for lang, m, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1], at[1:], strict=True):
            step = max(1, PAIRS // (b - a))
            for i in range(a, b - 1, step):
                s, t = np.triu_indices(min(step, b - i), 1, b - i)
                s, t = s + i, t + i
                value = difference(p[s], p[t]) - difference(p[s], z[t]) - difference(z[s], p[t]) + difference(z[s], z[t])
                sums.add(lang, idx[s], idx[t], value * m)
                yield from sums.full()
    yield from sums.batches()


def _pairs_with_absent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and second sum, of rows ``lang, kept, idx, z, counts array<struct<p, h>>, all array<struct<idx, z>>``, a row a source."""
    sums = _Sums()
    for batch in batches:
        at, (p, h) = _entries(batch.column(4), "p", "h")
        of, (idx, z) = _entries(batch.column(5), "idx", "z")
        for k, (lang, kept, own, own_z) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            others, their_z = idx[of[k] : of[k + 1]], z[of[k] : of[k + 1]]
            there = others != own
            others, their_z = others[there], their_z[there]
            none = difference(np.int64(own_z), their_z)
            value = np.where(others > own, kept * none, 0)
            step = max(1, PAIRS // max(1, len(others)))
            for i in range(at[k], at[k + 1], step):
                some = slice(i, min(i + step, at[k + 1]))
                value = value + ((difference(p[some, None], their_z[None, :]) - none) * h[some, None]).sum(axis=0)
            sums.add(lang, np.full(len(others), own), others, value)
            yield from sums.full()
    yield from sums.batches()


def audit(docs: DataFrame, scratch: Scratch, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources by their difference (part pair), and a source's first ``top`` own terms (part term)."""
    counts = scratch.table(term_counts(docs, lang_col, source_col, text_col))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = scratch.table(counts.where("term = ''").select("lang", "source", number.alias("idx")))
    rows = counts.where("term <> ''").join(sources, ["lang", "source"])
    vector = F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("v")
    terms = scratch.table(rows.groupBy("lang", "term").agg(vector, F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    vectors = scratch.table(terms.groupBy("lang", "v").agg(F.count("*").alias("m"), F.min("term").alias("name")))

    # what each source and language has of kept terms
    words = vectors.select("lang", "m", F.explode("v").alias("e")).groupBy("lang", F.col("e.idx").alias("idx")).agg(F.sum(F.col("m") * F.col("e.n")).alias("total"))
    kept = vectors.groupBy("lang").agg(F.sum("m").alias("kept"))
    whole = words.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = sources.join(words, ["lang", "idx"], "left").join(kept, ["lang"], "left").join(whole, ["lang"], "left").fillna(0, ["total", "kept", "lang_total"])
    known = scratch.table(known.withColumn("z", share("0L", "total", "kept")))

    # a row for each source of each distinct vector
    held = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("held")
    entries = vectors.select("lang", "name", "m", held, F.explode("v").alias("e")).select("lang", "name", "m", "held", "e.idx", "e.n").join(known, ["lang", "idx"])
    entries = scratch.table(entries.select("lang", "name", "m", "idx", share("n", "total", "kept").alias("p"), "z", share("held", "lang_total", "kept").alias("q")))

    both = entries.groupBy("lang", "name").agg(F.first("m").alias("m"), F.collect_list(F.struct("idx", "p", "z")).alias("v")).where("size(v) > 1").select("lang", "m", "v")
    histogram = entries.groupBy("lang", "idx", "p").agg(F.sum("m").alias("h")).groupBy("lang", "idx").agg(F.collect_list(F.struct("p", "h")).alias("counts"))
    everyone = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("idx", "z"))).alias("all"))
    none = F.array().cast("array<struct<p: long, h: long>>")
    alone = known.join(histogram, ["lang", "idx"], "left").join(everyone, ["lang"]).where("size(all) > 1").select("lang", "kept", "idx", "z", F.coalesce("counts", none), "all")
    schema = "lang string, s int, t int, value long"
    sums = both.mapInArrow(_pairs_in_vectors, schema).unionByName(alone.mapInArrow(_pairs_with_absent, schema)).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    ends = sums.select("lang", F.explode(F.array(F.struct(F.col("s").alias("idx"), F.col("t").alias("other")), F.struct(F.col("t").alias("idx"), F.col("s").alias("other")))).alias("e"), "value").select("lang", "e.idx", "e.other", "value")
    pairs = ends.join(sources, ["lang", "idx"]).join(sources.select("lang", F.col("idx").alias("other"), F.col("source").alias("item")), ["lang", "other"])

    # only vectors that can hold one of a source's first terms
    own = entries.where("p > q").select("lang", "idx", "name", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    best = own.withColumn("r", F.rank().over(Window.partitionBy("lang", "idx").orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    named = best.join(vectors.select("lang", "name", "v"), ["lang", "name"]).join(terms, ["lang", "v"]).join(sources, ["lang", "idx"])

    def ranked(rows: DataFrame, part: str, item: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item))
        return rows.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", place.alias("rank"))

    return ranked(pairs, "pair", "item").unionByName(ranked(named, "term", "term").where(F.col("rank") <= top))
