"""Structure repair, packing by the configuration program and the divergence audit against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import divergence, lp_packing, structure_repair
from sluice.llm._runtime import Scratch
from sluice.llm.queries import damaged, op11_structure_repair, op12_lp_packing, op13_divergence, tokenizer_path

TURNS = "conv_id long, turn long, role string, text string, report string, `a.b` int, fault string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx string, v string, place int, `a.b` int"


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def all_repairs(rows: str) -> tuple[int, str, str]:
    """The least (cost, audit) of all edits with at most two turns inserted at a place, and the roles it gives."""
    found = None
    per_row = []
    for row in rows:
        choices = [("D", 3, "")]
        if row != "-":
            worn = 1 if row.isupper() else 0
            choices += [("K", worn, row.lower()), ("R", 2 + worn, "u"), ("R", 2 + worn, "a")]
        per_row.append(choices)
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*per_row):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            roles = more[0] + "".join(e[2] + m for e, m in zip(edits, more[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(more[0]) + "".join(e[0] + "I" * len(m) for e, m in zip(edits, more[1:], strict=True))
                key = (sum(e[1] for e in edits) + 2 * sum(map(len, more)), audit, roles)
                found = key if found is None or key < found else found
    return found


def repaired(rows: str, block: int) -> tuple[int, str, str]:
    r = structure_repair.Repair(block)
    out = []
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for row in rows:
        fault = structure_repair.BLANK if row == "-" else structure_repair.CUT if row.isupper() else structure_repair.FINE
        out += r.feed(names[row.lower()], "t", fault)
    out += r.finish()
    assert not r.held
    return r.cost, "".join(r.audit), "".join(role[0] for edit, role, _ in out if edit != "D")


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(5)
    for n in range(4):
        for _ in range(12 if n == 3 else 20):
            rows = "".join(rng.choice("suaxSUA-") for _ in range(n))
            want = all_repairs(rows)
            assert repaired(rows, 100) == want, rows
            assert repaired(rows, 1) == repaired(rows, 2) == want, rows


def test_repair_in_blocks_equals_repair_at_once():
    rng = random.Random(6)
    for _ in range(150):
        rows = "".join(rng.choice("suauauauaxSUA-") for _ in range(rng.randrange(4, 60)))
        want = repaired(rows, 1000)
        assert all(repaired(rows, b) == want for b in (1, 3, 7, 16)), rows


def test_repair_decides_as_it_goes():
    r = structure_repair.Repair(64)
    held = 0
    for i in range(10_000):
        r.feed("user" if i % 2 == 0 else "assistant", "fine.", structure_repair.FINE)
        held = max(held, len(r.held))
    assert held <= 3 * 64
    r.finish()
    assert r.cost == 0 and "".join(r.audit) == "K" * 10_000


def test_repair_over_spark_on_odd_rows(spark):
    long = "word " * 200_000 + "."
    more = (None, None, None)
    rows = [
        (1, 0, "system", "Be kind.", *more), (1, 1, "user", "Hi.", *more), (1, 2, "assistant", "Hello there", *more), (1, 2, "assistant", "Hello there", *more), (1, 9, "user", long, *more),
        (2, None, None, None, *more), (2, None, "user", " \n", *more), (2, 3, "", "x.", *more),
        (None, 1, "user", "Yes!", *more), (None, 2, "assistant", "No?\n", *more),
        (3, 5, "tool", "out.", *more),
    ]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = structure_repair.repair_conversations(df).collect()
    reports = {r.conv_id: r.report for r in got if r.report is not None}
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in reports.items()} == {
        1: (6, 0, 1, 1, 1, 1 + 3 + 2, "KKKDKI"), 2: (0, 2, 0, 0, 2, 3 + 3 + 3, "DDD"), None: (0, 0, 0, 0, 0, 0, "KK"), 3: (0, 0, 0, 0, 0, 3, "D"),
    }
    assert [(r.role, r.text) for r in structure_repair.repaired_turns(structure_repair.repair_conversations(df.where("conv_id = 1"))).collect()] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello there"), ("user", long), ("assistant", "")]
    assert [r.text for r in got if r.conv_id == 1 and r.edit == "K"][-1] == long
    assert structure_repair.repair_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "a.b!c?") for c in (None, 1, 2, 77) for t in (None, *range(30))], "conv_id long, turn long, role string, text string")
    want = Counter()
    for c in (None, 1, 2, 77):
        for t in (None, *range(30)):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind:
                want[c, t, "user" if kind == 4 else "assistant", {1: "", 2: "abc"}.get(kind, "a.b!c?")] += 2 if kind == 3 else 1
    assert Counter(tuple(r) for r in damaged(df).collect()) == want


def test_op11_returns_conversations_without_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in op11_structure_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def best_packing(lengths: list[int], capacity: int) -> int:
    """The fewest sequences, by trying all places of each piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            i = rooms.index(room)
            place(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def check_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> lp_packing.Plan:
    made = lp_packing.plan(lengths, counts, capacity)
    held = Counter()
    for pattern, copies in made.patterns:
        assert copies > 0 and sum(int(lengths[j]) * n for j, n in pattern) <= capacity
        for j, n in pattern:
            held[j] += n * copies
    assert [held[j] for j in range(len(lengths))] == counts.tolist()
    layout = lp_packing.Layout(made)
    filled = defaultdict(list)
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sequence, offset = layout(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            filled[s].append((o, length))
    assert sorted(filled) == list(range(made.sequences))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return made


def test_plans_hold_each_piece_once_and_few_sequences():
    rng = random.Random(7)
    for _ in range(40):
        pieces = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 11))]
        lengths, counts = np.unique(np.asarray(pieces), return_counts=True)
        made = check_plan(lengths, counts, 30)
        best = best_packing(pieces, 30)
        assert made.lower_bound <= best + 1e-9 and made.sequences <= best + (1 if best > 3 else 0)
    for pieces, most in (
        ([1365] * 900, 300),
        ([2048] * 99 + [1] * 4, 50),
        ([1900] * 100 + [1100] * 200 + [1096] * 50 + [1000] * 150 + [996] * 120 + [700] * 200 + [596] * 70, 226),  # best fit alone takes 232
        ([4096] * 7, 7),
    ):
        lengths, counts = np.unique(np.asarray(pieces), return_counts=True)
        assert check_plan(lengths, counts, 4096).sequences <= most


def test_plan_of_a_large_histogram_doesnt_grow_with_its_counts():
    rng = np.random.default_rng(8)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 1.2, 50_000).astype(int), 1, 4096), return_counts=True)
    made = lp_packing.plan(lengths, counts * 10_000_000_000, 4096)
    assert made.sequences <= made.lower_bound * 1.001 and len(made.patterns) <= lp_packing.COLUMNS + 2 * len(lengths)


def test_packing_over_spark(spark, scratch, tiny):
    odd = [(1, None), (1, ""), (1, "same words here"), (1, "same words here"), (None, "no id"), (2, "word " * 30_000), (3, "nul\x00 and é" * 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", "v", 4, 5) for i, t in odd], DOCS).repartition(3)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in odd:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 512):
            own = ids[k : k + 512]
            want[i, k // 512, k, len(own), zlib.crc32(own.tobytes())] += 1
    got = lp_packing.pack(docs, tokenizer_path(), scratch, 512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert lp_packing.pack(docs.limit(0), tokenizer_path(), scratch).collect() == []
    for rows, capacity in ((got, 512), (op12_lp_packing(spark, tiny).collect(), 4096)):
        filled = defaultdict(list)
        for r in rows:
            filled[r.sequence_id].append((r.offset, r.length))
        for parts in filled.values():
            parts.sort()
            assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(n for _, n in parts) <= capacity
        assert len(filled) <= -(-sum(r.length for r in rows) // capacity) + 1


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, min_docs, top):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)}
    return out


def test_divergence_against_brute_force(spark, scratch, monkeypatch):
    rng = random.Random(9)
    words = ["Alpha", "beta", "élan", "straße", "x", "y", "zeta", "日本", "İ", "only"] + [f"w{c}" for c in "abcdefghijklmno"]
    rows = [(lang, source, " ".join(rng.choice(words[: 5 + 4 * k]) for _ in range(rng.randrange(0, 30))) + rng.choice(["", "\x00", "1a-b", "\n"])) for lang in ("en", None, "de") for k, source in enumerate(["a", "b", None, "Z", "ü"]) for _ in range(8)]
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("fr", "alone", "un deux"), ("it", "p", "uno"), ("it", "q", None), ("en", "a", "alpha " * 300_000), ("en", "b", "q" * 5_000_000 + " beta")]
    docs = spark.createDataFrame([(1, t, lang, source, 1, "i", "v", 2, 3) for lang, source, t in rows], DOCS).repartition(5)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    for min_docs, top in ((1, 3), (4, 10), (1000, 10)):
        got = divergence.audit(docs, scratch, min_docs, top).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows, min_docs, top)
    assert divergence.audit(docs.limit(0), scratch).collect() == []


def test_divergence_of_sources_and_counts_in_many_bins(spark, scratch):
    rng = random.Random(10)
    rows = [("en", f"s{k}", " ".join(f"t{chr(97 + int(rng.paretovariate(0.7)) % 26)}" for _ in range(60))) for k in range(40) for _ in range(3)]
    docs = spark.createDataFrame([(1, t, lang, source, 1, "i", "v", 2, 3) for lang, source, t in rows], DOCS)
    assert {tuple(r) for r in divergence.audit(docs, scratch, 2, 5).collect()} == brute_divergence(rows, 2, 5)


def test_divergence_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    monkeypatch.setattr(divergence, "SLICE", 10)
    assert [w for part in divergence._slices(b"one two three four fivesixseveneight nine") for w in part] == [b"one", b"two", b"three", b"four", b"fivesixseveneight", b"nine"]
    assert len(list(divergence._slices(b"x" * 50))) == 1


def test_op13_over_a_small_table(spark, tiny):
    got = op13_divergence(spark, tiny)
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, 10, 10)
    assert got.where(F.col("rank").isNull()).count() == 0
