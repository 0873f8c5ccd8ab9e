"""Personal data: fixed patterns, and identifiers found by bootstrapping their contexts.

Base kinds are found by fixed patterns in linear time.  Bootstrapping: seeds are the base entities and tokens of
a well-known shape of secret.  The places of seeds induce lexical patterns of five forms (``contexts``): what
stands before and after, one or two words, with the punctuation between, and the shape of the token.  Every
other token with a digit is a candidate; one that is too short for an identifier is evidence against a pattern.

Spark scores the graph of patterns and instances in rounds.  A pattern's confidence is the mean score of its
distinct instances, smoothed towards 0; it is accepted with ``MIN_CONFIDENCE`` and ``MIN_SUPPORT`` different
instances that score, and keeps the confidence it then has.  A seed scores 1, a candidate the confidence of its best accepted pattern, so what one
round discovers supports the patterns of the next, until a round accepts none: each round accepts one at least, so there is an end, and
it depends on no number of rounds.  Candidates in accepted patterns become spans of kind ``id``.

Defined cases: null text is empty; a row's result depends on its text and the corpus, so repeated rows repeat
it; null ids are kept; no documents give no rows; ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Scratch, finished, prepare

KINDS = ("email", "ip", "card", "phone")
LEARNED = "id"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns. A digit never precedes a match that begins with one, as the match would have begun there.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[^0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_./+~%-])[A-Za-z_./+~%-]*+[0-9][A-Za-z0-9_./+~%-]*+")
_TRIM = "._/+~%-"
_WORD = re.compile(r"[^\W\d_]+")
_AFTER = re.compile(r"([^\w\s]*+)\s*+([^\W\d_]*+)")
# Shapes of secrets that are seeds: digests and keys in hexadecimal, UUIDs, cloud and service keys, signed web tokens.
_SECRET = re.compile(
    r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"
)
# Words before hexadecimal digests that are no secrets; a seed's shape counts for nothing after them.
_HARMLESS = frozenset("commit commits checksum digest etag hash md rev revision sha".split())
#: Characters looked at first for the words before a place; the whole text is where they don't suffice.
NEAR = 64
MIN_CONFIDENCE = 0.5
#: A score of 1; scores are whole numbers, so that sums don't depend on their order.
ONE = 10**9
MIN_SUPPORT = 3
#: Shorter tokens are no identifiers.
MIN_ID = 5


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of the base entities, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def _shape(token: str) -> str:
    """The token's character classes: digits and hexadecimal digits by their number, else runs of digits, upper and lower case."""
    if token.isdigit():
        return f"d{len(token)}"
    if len(token) > 7 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        return f"x{len(token)}"
    return re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "9", token)))


def contexts(text: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, list[str]]]:
    """The nearest word before each of the places (ascending by start) and the patterns of the place.

    Words are lower-cased runs of letters, a gap is what lies between the nearest word and the place without white
    space, places in it as ``0``.  Patterns: the word and a gap; two words and the gap; gap and shape of the token;
    gap and what follows; the word, the gap and what follows.  Those that need a gap, a word or a follower and have none are left out.
    """
    starts = None
    ends, last, earlier = [], 0, 0  # ends of places that are still open; the largest closed ones
    for a, b in places:
        while ends and ends[0] <= a:
            last = max(last, ends.pop(0))
        low = max(0, a - NEAR)
        near = list(_WORD.finditer(text, low, a))
        if len(near) < 3 and low:
            if starts is None:
                whole = [m.span() for m in _WORD.finditer(text)]
                starts = [x for x, _ in whole]
            k = bisect_left(starts, a)
            spans = [(x, min(y, a)) for x, y in whole[max(0, k - 2) : k]]
        else:
            spans = [m.span() for m in near[-2:]]
        words = [text[x:y].lower() for x, y in spans]
        word = words[-1] if words else ""
        end = spans[-1][1] if spans else 0
        gap = "".join(("0" if last > end else "", *text[max(last, end) : a].split()))
        m = _AFTER.match(text, b)
        mark, follower = m[1], m[2].lower()
        out = []
        if gap and word:
            out.append(f"1 {word} {gap}")
        if len(words) > 1:
            out.append(f"2 {words[0]} {word} {gap}")
        if gap:
            out.append(f"3 {gap} {_shape(text[a:b])} {mark}")
            if follower:
                out.append(f"4 {gap} {mark} {follower}")
        if word and follower:
            out.append(f"5 {word} {gap} {mark} {follower}")
        yield word, out
        ends.append(b)
        ends.sort()


def tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit that touch no base entity."""
    k = 0
    taken = sorted((a, b) for a, _, b in spans)
    for m in _TOKEN.finditer(text):
        token = m[0].lstrip(_TRIM)
        a = m.end() - len(token)
        b = a + len(token.rstrip(_TRIM))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b):
            yield a, b


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


SCAN = "doc_id long, text_hash long, base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, end: int, instance: long, seed: boolean, able: boolean, patterns: array<long>>>"
_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("able", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))


def evidence(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool, bool, list[str]]]:
    """``start, end, seed, able, patterns`` of the base entities (never able) and the other tokens with a digit (able to be identifiers)."""
    if not _DIGIT.search(text):
        places = [(a, b, True) for a, _, b in spans]
    else:
        places = sorted([(a, b, True) for a, _, b in spans] + [(a, b, False) for a, b in tokens(text, spans)])
    for (a, b, base), (word, patterns) in zip(places, contexts(text, [p[:2] for p in places]), strict=True):
        token = text[a:b]
        seed = base or (word not in _HARMLESS and _SECRET.fullmatch(token) is not None)
        yield a, b, seed, not base and len(token) >= MIN_ID, patterns


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, founds = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            spans = base_spans(text)
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            founds.append([{"start": a, "end": b, "instance": _hash(text[a:b]), "seed": seed, "able": able, "patterns": list(map(_hash, patterns))} for a, b, seed, able, patterns in evidence(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, _BASE_TYPE), pa.array(founds, _FOUND_TYPE)], names=["doc_id", "text_hash", "base", "found"])


def confident_patterns(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``pattern, confidence`` of the accepted patterns, from ``pattern, instance, seed, able``.

    Scores are kept as differences: a round looks at the instances of patterns that the last one accepted, and adds to the patterns of those
    whose score they raise.  Patterns with too few instances that could ever score are left out of the graph at once; they can't be accepted.
    """
    pairs = found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("able").alias("able"))
    pairs = scratch.table(pairs)
    enough = pairs.groupBy("pattern").agg(F.count_if(F.col("seed") | F.col("able")).alias("n")).where(F.col("n") >= MIN_SUPPORT).select("pattern")
    graph = scratch.table(pairs.join(enough, "pattern"))
    candidates = graph.where("able AND NOT seed").select("pattern", "instance")

    def fit(totals: DataFrame) -> DataFrame:
        """Of ``pattern, score, support, n`` those that are accepted."""
        confidence = F.expr("score div (n + 1)")
        return totals.where((confidence >= int(MIN_CONFIDENCE * ONE)) & (F.col("support") >= MIN_SUPPORT)).select("pattern", confidence.alias("confidence"))

    totals = scratch.table(graph.groupBy("pattern").agg((F.count_if("seed") * ONE).alias("score"), F.count_if("seed").alias("support"), F.count("*").alias("n")))
    accepted = new = scratch.table(fit(totals))
    scores: DataFrame | None = None
    while not new.isEmpty():
        raised = candidates.join(new, "pattern").groupBy("instance").agg(F.max("confidence").alias("score"))
        if scores is not None:
            had = scores.groupBy("instance").agg(F.max("score").alias("had"))
            raised = raised.join(had, "instance", "left").where("had IS NULL OR score > had")
        else:
            raised = raised.withColumn("had", F.lit(None).cast("long"))
        raised = scratch.table(raised)
        more = candidates.join(raised, "instance").groupBy("pattern").agg(F.sum(F.col("score") - F.coalesce("had", F.lit(0))).alias("score"), F.count_if(F.col("had").isNull()).alias("support"), F.lit(0).cast("long").alias("n"))
        more = scratch.table(more)
        scores = raised.select("instance", "score") if scores is None else scores.union(raised.select("instance", "score"))
        totals = totals.union(more)
        open_ = more.select("pattern").join(accepted, "pattern", "left_anti")
        grown = totals.join(open_, "pattern", "left_semi").groupBy("pattern").agg(F.sum("score").alias("score"), F.sum("support").alias("support"), F.sum("n").alias("n"))
        new = scratch.table(fit(grown))
        accepted = accepted.union(new)
    return accepted.withColumn("confidence", F.col("confidence") / ONE)


def find_pii(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, base, learned``: a row for each row; spans in code points, end exclusive. Reads tables of ``scratch``."""
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    scanned = scratch.table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(_scan, SCAN))
    found = scanned.select("doc_id", "text_hash", F.explode("found").alias("f")).select("doc_id", "text_hash", "f.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = confident_patterns(found.select("pattern", "instance", "seed", "able"), scratch)
    learned = found.where("able").join(good, "pattern").groupBy(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("learned"))
    hopeful = F.exists("found", lambda f: f["able"])
    some = scanned.where(hopeful).select("doc_id", "text_hash", "base").join(learned, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")), "left").drop("l_id", "l_hash")
    return some.union(scanned.where(~hopeful).select("doc_id", "text_hash", "base", F.lit(None).cast("array<struct<start: int, end: int>>")))


def redact(docs: DataFrame, keep: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with each span of the text replaced by its kind in brackets, overlapping spans by the first's. Reads a table of ``keep``."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    spans = find_pii(docs, scratch, id_col, text_col).where("size(base) > 0 OR size(learned) > 0").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), F.struct("base", "learned").alias("spans"))
    spans = finished(spans, scratch, keep)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = [n for c, n in zip(docs.columns, names, strict=True) if c != text_col]
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True) if c != text_col))
    joined = held.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.xxhash64("text") == F.col("span_hash")), "left").select("text", "spans", *rest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and found:
                    places = sorted([(s["start"], s["kind"], s["end"]) for s in found["base"]] + [(s["start"], len(KINDS), s["end"]) for s in found["learned"] or ()])
                    parts, last = [], 0
                    for a, k, b in places:
                        if a >= last:
                            parts += [text[last:a], f"[{(*KINDS, LEARNED)[k].upper()}]"]
                        last = max(last, b)
                    text = "".join(parts) + text[last:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])

    schema = ", ".join(["text string", *(f"{n} {joined.schema[n].dataType.simpleString()}" for n in rest)])
    out = joined.mapInArrow(work, schema)
    return out.select(*(F.col("text" if c == text_col else n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
