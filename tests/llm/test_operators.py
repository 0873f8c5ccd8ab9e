"""Each operator against brute force or an exact round trip, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, chat_format, embedding_dedup, licenses, near_dedup, packing, pii, quality, substring_dedup, token_files
from sluice.llm._runtime import Scratch, finished
from sluice.llm._tokens import WordEncoder
from sluice.llm.queries import op2_pii, op3_chat_format, tokenizer_path
from sluice.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, `a.b` int, gone_id string, N_Words int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base, shared = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    out = {1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: " \n\t ", 7: "one two three", 8: "one two three", 9: prose(rng, 40) + " " + shared, 10: shared + " " + prose(rng, 90), 11: "é" * 3000 + " " + prose(rng, 20000), 12: ("la la la li " * 40).strip(), 13: "nul\x00 and \x1c control   sep", 14: base[: len(base) // 2] + prose(rng, 60)}
    chain = base.split()
    for i in range(20, 40):  # each like the one before, the last unlike the first
        chain = list(chain)
        chain[(i * 6) % 115] = f"w{i}"
        out[i] = " ".join(chain)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "k", "h", 1, "g", 2) for i, t in texts.items()]
    rows += [(7, "one two three", None, None, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_near_duplicates(docs, empty, texts, scratch):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        if w:
            sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = near_dedup.near_duplicates(docs, scratch).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == {i: find(i) for i in texts}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows if r["doc_id"] is not None)
    assert sum(r["doc_id"] is None and r["kept"] for r in rows) == 2
    assert near_dedup.near_duplicates(empty, scratch).count() == 0
    assert near_dedup.without_near_duplicates(docs).columns == docs.columns


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = {int(k): int(w) for k, w in zip(rng.integers(0, 2**62, 60), rng.integers(1, 5, 60), strict=True)}
    b = dict(list(a.items())[:45]) | {int(k): 2 for k in rng.integers(0, 2**62, 10)}
    d, h, w = (np.asarray(x) for x in zip(*[(i, k, v) for i, s in enumerate((a, b)) for k, v in sorted(s.items())], strict=True))
    m = near_dedup.prob_minhash(d, h.astype(np.uint64), w, 2, 4096)
    assert abs((m[0] == m[1]).mean() - probability_jaccard(a, b)) < 0.03


def test_links_of_weighted_sets():
    """Similarities and components of random weighted sets against the definition."""
    rng = random.Random(14)
    for _ in range(30):
        base = {k: rng.randrange(1, 4) for k in range(30)}
        sets = [{k: w for k, w in base.items() if rng.random() < 0.97} | ({100 + i: rng.randrange(1, 3)} if rng.random() < 0.5 else {}) for i in range(25)]
        sets = [{k: 1 for k in s} if rng.random() < 0.3 else s for s in sets]
        rows = [(i, w, sets[0][k]) for i, s in enumerate(sets) for k, w in s.items() if k in sets[0]]
        y, b, a = (np.asarray(c) for c in zip(*rows, strict=True))
        got = near_dedup.probability_jaccards(y, a.astype(float), b.astype(float), float(sum(sets[0].values())), np.asarray([float(sum(s.values())) for s in sets]))
        want = [probability_jaccard(sets[0], s) for s in sets]
        assert np.allclose(got, want)
        keys = [np.asarray(sorted(s), dtype=np.uint64) for s in sets]
        weights = [None if all(w == 1 for w in s.values()) else np.asarray([s[int(k)] for k in ks]) for s, ks in zip(sets, keys, strict=True)]
        links = near_dedup.linked(list(range(25)), keys, weights, 0.8)
        assert all(probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9 for i, j in links)
        groups = []
        for edges in (links, [(i, j) for i in range(25) for j in range(i) if probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9]):
            of = list(range(25))
            for i, j in edges:
                of = [of[i] if x == of[j] else x for x in of]
            groups.append({frozenset(k for k in range(25) if of[k] == g) for g in of})
        assert groups[0] == groups[1]


def test_blocks_of_a_large_bucket(spark, monkeypatch, scratch):
    """Buckets of many blocks: near copies of one text, chains beside them, and texts that share a bucket but are unlike."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    rng = random.Random(2)
    w = prose(rng, 200).split()
    rows = []
    for i in range(60):
        v = list(w)
        v[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(v)))
    for i in range(60, 100):  # far from the first text, each like the one before
        v = list(v)
        v[(i * 7) % 200] = f"y{i}"
        rows.append((i, " ".join(v)))
    for i in range(100, 130):  # about 0.7 alike, mostly without a link
        v = list(w)
        for k in rng.sample(range(200), 5):
            v[k] = f"z{i}.{k}"
        rows.append((i, " ".join(v)))
    sets = {i: Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i].keys() & sets[j].keys())
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in sets} and len({find(i) for i in sets}) > 1


def test_near_duplicates_recall_by_similarity(spark, scratch):
    """Copies of 120 texts with 0 to 24 of 240 words changed: all pairs of 0.8 or more are found, none below."""
    rng = random.Random(31)
    rows, similar = [], {}
    for k in range(120):
        w = prose(rng, 240).split()
        v = list(w)
        for at in rng.sample(range(240), k // 5):
            v[at] = f"q{k}.{at}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        a, b = (set(zip(*(x[i:] for i in range(5)), strict=False)) for x in (w, v))
        similar[k] = len(a & b) / len(a | b)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    found = {k for k in similar if got[2 * k] == got[2 * k + 1]}
    assert found == {k for k, x in similar.items() if x >= 0.8} and 10 < len(found) < 100


def brute_substring(texts, size=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def test_substring_dedup(docs, empty, texts, monkeypatch, scratch):
    want = brute_substring(texts)
    for cells, flush in ((None, None), (64, 50)):  # the second fills the sketch and sends often
        if cells:
            monkeypatch.setattr(substring_dedup, "shape_for", lambda n: (512, 64))
            monkeypatch.setattr(substring_dedup, "FLUSH", flush)
            monkeypatch.setattr(substring_dedup, "FLUSH_REPEATED", flush)
        rows = substring_dedup.remove_repeats(docs, scratch).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_removed"], WORD.findall(r["text"] or "")) == want[r["doc_id"]]
                if not r["n_removed"]:
                    assert r["text"] == texts[r["doc_id"]]
    assert substring_dedup.remove_repeats(empty, scratch).count() == 0


def test_substring_dedup_prefilter(spark, scratch, monkeypatch):
    """Unique windows are done with in the first pass, at either size; a partition that holds other rows the second time loses nothing."""
    sent = {}
    for n in (300, 3000):
        rng = random.Random(n)
        passage = prose(rng, 30)
        df = spark.createDataFrame([(i, prose(rng, 80) + (" " + passage if i % 50 == 0 else "")) for i in range(n)], "doc_id long, text string").repartition(4)
        path = scratch.path()
        df.write.parquet(path)
        plain = spark.read.parquet(path)
        cells, slices = substring_dedup.shape_for(plain.agg(F.sum(F.octet_length("text"))).first()[0])
        answered = substring_dedup.answers(plain, 13, cells, slices, scratch)
        windows = plain.count() * 68

        def estimated(batches, a=answered, c=cells, s=slices):
            import pyarrow as pa
            from pyspark import TaskContext

            known = substring_dedup.Answers(a, TaskContext.get().partitionId(), c, s)
            for unit, parts in substring_dedup._units(batches, 13, substring_dedup.FLUSH):
                yield pa.RecordBatch.from_arrays([pa.array([int(known.repeated(unit, np.concatenate([h[w] for _, _, h, w in parts])).sum())], pa.int64())], names=["n"])

        rows = plain.mapInArrow(estimated, "n long").agg(F.sum("n")).first()[0]
        sent[n] = rows / windows
        other = plain.repartition(3)
        want = brute_substring({r["doc_id"]: r["text"] for r in plain.collect()})
        seen = substring_dedup.repeated_windows(other, 13, answered, cells, slices, 12)
        assert sum(len(r["d"]) // 8 for r in seen.collect()) >= sum(1 for k, w in want.items() if w[1])
    assert max(sent.values()) < 0.1 and abs(sent[300] - sent[3000]) < 0.05, sent


def plain_spans(text):
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans():
    rng = random.Random(4)
    odd = ["a@b.c.@d.e", "a@b.c@d.e f.@g.h-i.j.", "@a.b", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (234) 567.8901x +12", "é+1234567890 ü a.b@c.de"]
    for _ in range(20000):
        odd.append("".join(rng.choice("ab@.+-_% 0123456789()é1455") for _ in range(rng.randrange(40))))
    for t in odd:
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200000 + "1" * 200000 + " @" * 1000) == []
    assert list(pii.tokens("x" * 200000 + " ab12-345, y=_9/ 7", [])) == [(200001, 200009), (200014, 200015), (200017, 200018)]


def test_pii_learns_contexts(spark, tmp_path):
    rows = [(i, f"please call on +1 555 010 {i:04d} now") for i in range(8)] + [(20, "please call on 55501-0999. thanks"), (21, "room 12345 is free"), (22, None), (22, None), (None, "call on +1 555 010 7777")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op2_pii(spark, str(tmp_path)).collect()}
    assert got[20]["spans"] == "id:15:25" and got[20]["n_id"] == 1 and got[21]["spans"] == "" and got[22]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["spans"] == "phone:15:30" and got[0]["n_phone"] == 1 and got[0]["base_sha256"] == hashlib.sha256(b"phone:15:30").hexdigest()
    assert op2_pii(spark, str(tmp_path)).count() == len(rows)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[20] == "please call on [ID]. thanks" and red[0] == "please call on [PHONE] now" and red[21] == "room 12345 is free" and red[22] is None and red[None] == "call on [PHONE]"


def test_pii_long_identifiers(spark):
    key, token, gap = "0x" + "3f" * 32, "9a" * 64, " " * 100
    rows = [(i, f"please call on +1 555 010 {i:04d} now") for i in range(8)] + [(20, f"please call on {key}. thanks"), (21, f"call{gap}on {token}"), (22, f"we call on{gap}55501-0999 and {key}")]
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[20] == "please call on [ID]. thanks" and red[21] == f"call{gap}on [ID]" and red[22] == f"we call on{gap}[ID] and {key}"


def plain_contexts(text, places):
    """The same in the plainest words: over the whole text for each place."""
    for n, (a, b) in enumerate(places):
        found = [(m.start(), min(m.end(), a)) for m in re.finditer(r"[^\W\d_]+", text) if m.start() < a][-2:]
        words = [text[x:y].lower() for x, y in found]
        word = words[-1] if words else ""
        closed = max([e for _, e in places[:n] if e <= a], default=0)
        end = found[-1][1] if found else 0
        gap = ("0" if closed > end else "") + "".join(c for c in text[max(closed, end) : a] if not c.isspace())
        m = re.match(r"([^\w\s]*)\s*([^\W\d_]*)", text[b:])
        mark, follower = m[1], m[2].lower()
        out = [f"1 {word} {gap}"] if gap and word else []
        out += [f"2 {words[0]} {word} {gap}"] if len(words) > 1 else []
        out += [f"3 {gap} {pii._shape(text[a:b])} {mark}"] if gap else []
        out += [f"4 {gap} {mark} {follower}"] if gap and follower else []
        out += [f"5 {word} {gap} {mark} {follower}"] if word and follower else []
        yield word, out


def test_pii_contexts():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["ab ", "Ünd", "İx ", "c", "1234567 ", "_", "é", " ", '= "', "!)", " " * 70, "1" * 80, "z" * 90, "\x85", "日本"]) for _ in range(rng.randrange(30)))
        places = sorted((a, min(len(text), a + rng.randrange(1, 9))) for a in rng.sample(range(len(text) + 1), min(8, len(text))) if a < len(text))
        assert list(pii.contexts(text, places)) == list(plain_contexts(text, places)), text
    assert sum(1 for _ in pii.contexts("x" * 200000 + " 12345" * 30000, [(200001 + 6 * k, 200006 + 6 * k) for k in range(30000)])) == 30000


def plain_bootstrap(found):
    """Accepted patterns and their confidence of rows of pattern, instance, seed, able."""
    seed, able, graph = set(), set(), defaultdict(set)
    edge_seed = defaultdict(bool)
    edge_able = defaultdict(bool)
    for p, i, s, a in found:
        graph[p].add(i)
        edge_seed[p, i] |= s
        edge_able[p, i] |= a
    known, accepted = {}, {}
    while True:
        new = {}
        for p, instances in graph.items():
            scores = [pii.ONE if edge_seed[p, i] else known.get(i, 0) if edge_able[p, i] else 0 for i in instances]
            confidence = sum(scores) // (len(scores) + 1)
            if p not in accepted and confidence >= pii.MIN_CONFIDENCE * pii.ONE and sum(x > 0 for x in scores) >= pii.MIN_SUPPORT:
                new[p] = confidence
        if not new:
            return {p: c / pii.ONE for p, c in accepted.items()}
        accepted |= new
        for p, c in new.items():
            for i in graph[p]:
                if edge_able[p, i] and not edge_seed[p, i]:
                    known[i] = max(known.get(i, 0), c)


def test_pii_scores_equal_brute_force(spark, scratch):
    rng = random.Random(12)
    grew = 0
    for _ in range(6):
        of = {i: (rng.random() < 0.3, rng.random() < 0.7) for i in range(60)}
        rows = [(rng.randrange(30), rng.randrange(60)) for _ in range(160)]
        rows = [(p, i, of[i][0], of[i][1] and not of[i][0]) for p, i in rows]
        got = {r["pattern"]: r["confidence"] for r in pii.confident_patterns(spark.createDataFrame(rows, "pattern long, instance long, seed boolean, able boolean"), scratch).collect()}
        want = plain_bootstrap(rows)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        grew += any(not of[i][0] for p, i, _, _ in rows if p in want)
    assert grew
    # A chain in which each pattern is accepted by what the one before discovered: no number of rounds cuts it short.
    rows = [(0, i, True, False) for i in range(300)] + [(p, 1000 * p + i, False, True) for p in range(1, 9) for i in range(40)] + [(p - 1, 1000 * p + i, False, True) for p in range(1, 9) for i in range(40)]
    accepted = {r["pattern"] for r in pii.confident_patterns(spark.createDataFrame(rows, "pattern long, instance long, seed boolean, able boolean"), scratch).collect()}
    assert accepted == set(plain_bootstrap(rows))
    assert pii.confident_patterns(spark.createDataFrame([], "pattern long, instance long, seed boolean, able boolean"), scratch).count() == 0


def test_pii_finds_planted_identifiers(spark, tmp_path):
    """Identifiers of no seed's shape in the contexts of seeds, other numbers elsewhere, and a context that only discovered identifiers share."""
    rng = random.Random(13)
    code = lambda: f"{rng.choice('KLMN')}{rng.randrange(10**5, 10**6)}-{rng.choice('xyz')}"
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], {}
    for k in range(240):
        start, end = prose(rng, rng.randrange(1, 30)), prose(rng, 5)
        what = code() if k % 4 == 0 else hexes(40)
        form = k % 3
        if form == 0:
            text = f'{start} token = "{what}" {end}'
        elif form == 1:
            text = f"{start} api_key: {what}; {end}"
        else:
            text = f"{start} in chapter {rng.randrange(10**4, 10**6)} {end} commit {hexes(40)} {end}"
        if form < 2:
            at = text.index(what)
            planted[k] = f"id:{at}:{at + len(what)}"
        rows.append((k, text))
    moved = [r[1].split('"')[1] for r in rows if r[0] % 12 == 0][:12]
    for k, what in enumerate(moved):  # what the first rounds discover supports a pattern without any seed
        rows.append((1000 + k, f"{prose(rng, 4)} badge <{what}> shown"))
        planted[1000 + k] = f"id:{rows[-1][1].index(what)}:{rows[-1][1].index(what) + len(what)}"
    rows.append((2000, f"{prose(rng, 4)} badge <Q77777> shown"))
    planted[2000] = f"id:{rows[-1][1].index('Q77777')}:{rows[-1][1].index('Q77777') + 6}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["spans"] for r in op2_pii(spark, str(tmp_path)).collect()}
    right = sum(got[k] == s for k, s in planted.items())
    wrong = sum("id:" in got[k] for k, _ in rows if k not in planted)
    assert right >= 0.97 * len(planted) and wrong == 0 and got[2000] == planted[2000]


def test_pii_odd_tables(spark, docs, empty, scratch):
    assert pii.find_pii(empty, scratch).count() == 0 and pii.redact(empty).columns == empty.columns and pii.redact(empty).count() == 0
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert Counter((r["doc_id"], r["text"]) for r in red.collect()) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    long = prose(random.Random(1), 300_000) + ' token = "' + "5e" * 20 + '"'
    rows = [(k, long + str(k)) for k in range(2)] + [(None, f'token = "{"%040x" % (7**40 + k)}"') for k in range(4)] + [(5, 'token = "short-8x"'), (6, None), (6, "")]
    clash = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, span_id int")
    got = pii.redact(clash).collect()
    assert all(r["text"].endswith('token = "[ID]"' + (str(r["doc_id"]) if r["doc_id"] in (0, 1) else "")) for r in got if r["doc_id"] != 6), [r["text"][-40:] for r in got if r["text"]]
    assert len(got) == len(rows) and all(r["spans"] == "x" for r in got)


NASTY = ["", "a\\b</s>\\\\", "<|turn|>x<|text|>y<|end|>", "[INST] [[INST]] <<SYS>>", "\\<\\|end|>", "日本 é\n\nx", "<" * 50, "\\" * 7 + "</s>"]


def test_chat_escape_and_windows():
    rng = random.Random(6)
    pieces = [*chat_format.CONTROL, "\\", "<", "|", ">", "[", "]", "/", "s", " "]
    for t in NASTY + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(5000)]:
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)
    count = lambda t: 4 + len(t.split())
    for _ in range(300):
        turns = [("system", "be brief")] if rng.random() < 0.5 else []
        turns += [(rng.choice(["user", "assistant", "assistant", "tool\n", "system"]), rng.choice(NASTY) + " w" * rng.randrange(60)) for _ in range(rng.randrange(12))]
        budget, history = rng.randrange(20, 200), 40
        out = chat_format.windows(turns, budget, history, count)
        fresh, said, at = [], [], 0
        for w in out:
            read = chat_format.read_window(w["text"])
            new = read[w["n_context"] :]
            fresh += new
            said += [chat_format.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
            sizes = [count(chat_format.formatted(*t)) for t in read]
            assert w["n_tokens"] == sum(sizes) and (w["n_tokens"] <= budget or len(new) == 1)
            fixed = 1 if turns[0][0] == "system" and at else 0
            assert not fixed or read[0] == turns[0]
            repeated = w["n_context"] - fixed
            assert read[fixed : w["n_context"]] == turns[at - repeated : at] and sum(sizes[fixed : w["n_context"]]) <= history
            if at + len(new) < len(turns):  # the next turn wouldn't have fitted
                assert w["n_tokens"] + count(chat_format.formatted(*turns[at + len(new)])) > budget
            earlier = at - repeated - 1
            if earlier >= (1 if turns[0][0] == "system" else 0) and at:  # nor one more of the past
                more = count(chat_format.formatted(*turns[earlier]))
                assert sum(sizes[fixed : w["n_context"]]) + more > history or sum(sizes[: w["n_context"] + 1]) + more > budget
            at += len(new)
        assert fresh == turns and said == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (2, None, None, "x"), (None, 1, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op3_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    odd = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == sha(f"user\n{odd}\nassistant\n{odd}\n") and got[-1]["loss_sha256"] == sha(odd) and got[-1]["loss_chars"] == len(odd)
    assert got[1]["turns_sha256"] == sha("user\n\nuser\n\nassistant\nb\n") and got[1]["n_turns"] == 3 and got[2]["turns_sha256"] == sha("\nx\n") and None in got


def test_chat_budget_counts_ids(spark, library):
    encode, _ = library
    rows = [(1, k, "assistant" if k % 2 else "user", "日本語の長い文章です。" * 60, "x") for k in range(6)] + [(2, 0, "user", "w " * 300_000, "y"), (2, 1, "assistant", None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    got = defaultdict(list)
    for r in chat_format.format_conversations(df, tokenizer_path(), budget=4096).collect():
        got[r["conv_id"]].append(r)
        assert r["n_tokens"] == len(encode(r["text"])) and (r["n_tokens"] <= 4096 or len(chat_format.read_window(r["text"])) - r["n_context"] == 1)
    assert len(got[1]) > 1 and len(got[2]) == 2 and [r["window"] for r in sorted(got[1], key=lambda r: r["window"])] == list(range(len(got[1])))
    assert chat_format.format_conversations(df.limit(0), tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, lambda i: t.decode(i, skip_special_tokens=False)


ODD_TEXTS = ["Hello World's  café café 123 <|endoftext|>x’s日本<|startoftext|>'ll ΑΣ ΣΑΣ. İ ﬁ ǅ", "a<|endoftext|b", "한글 🎉👩‍👩‍👧 \x00\x1c\x85z y", "tAh'SAS 'S x'd don't ''s", " ́a ́", "1234٣½ Ⅷ", "Ébauche; straße? ŒUVRE, x" * 50]


def test_encoders_equal_the_library(texts, library, monkeypatch):
    encode, decode = library
    model, words = bpe.WordBPE(tokenizer_path()), WordEncoder(tokenizer_path())
    assert words.plain
    cases = [t or "" for i, t in texts.items() if i != 11] + ODD_TEXTS
    for t in cases:
        want = encode(t)
        assert model.encode(t) == want and model.decode(want) == decode(want)
        assert np.frombuffer(words.encode([t.encode()])[0], "<u4").tolist() == want
    monkeypatch.setattr(bpe, "HALF", 5)
    import sluice.llm._tokens as tokens

    monkeypatch.setattr(tokens, "HALF", 5)  # tables that turn over all the time
    raw = [t.encode() for t in cases]
    for t, got, ids in zip(cases, words.encode(raw), model.words(raw), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encode(t) == [int(i) for i in ids.split()] and model.decode_decimal(ids) == decode(encode(t))


def test_a_batch_learns_its_words_once(texts, library, monkeypatch):
    encode, _ = library
    words, learned = WordEncoder(tokenizer_path()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda some: (learned.append(list(some)), learn(some)))
    cases = [t or "" for i, t in texts.items() if i != 11] + ODD_TEXTS
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in words.encode([t.encode() for t in cases])] == [encode(t) for t in cases]
    assert len(learned) == 1 and len(set(learned[0])) == len(learned[0])
    assert words.encode([]) == [] and words.encode([b"", b" "]) == [b"", b""] and len(learned) == 1


def test_characters_of_every_version(library):
    """Every third code point but surrogates, many to a text, between letters, digits and marks."""
    encode, _ = library
    model = bpe.WordBPE(tokenizer_path())
    points = [c for c in range(0x80, 0x110000, 3) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 40):
        t = " ".join(f"a{chr(c)}b1{chr(c)}.{chr(c)}" for c in points[i : i + 40])
        if model.encode(t) != encode(t):
            assert not [hex(ord(w[1])) for w in t.split(" ") if len(w) > 1 and model.encode(w) != encode(w)]


def test_bpe_operators(docs, empty, texts, library):
    encode, decode = library
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in bpe.round_trip(docs, tokenizer_path()).collect():
        if r["doc_id"] is not None:
            ids = encode(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(decode(ids)))
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()}[7] == decode(encode("one two three"))
    assert bpe.round_trip(empty, tokenizer_path()).count() == 0


def test_token_file_format():
    rng = np.random.default_rng(3)
    for planes in ("byte", "bit"):
        docs = [(int(i) - 2, rng.integers(0, 2 ** int(rng.integers(1, 31)), int(n), dtype=np.uint32).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 5000, 3, 200000])]
        assert [(i, x.astype("<u4").tobytes()) for i, x in token_files.decode_file(token_files.encode_file(docs, planes))] == docs
        assert token_files.decode_file(token_files.encode_file([], planes)) == []
    with pytest.raises(ValueError):
        token_files.decode_file(b"nope")


def test_token_files(docs, empty, texts, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    encode, _ = library
    folder = f"file://{tmp_path}/t"
    files = token_files.write_token_files(docs, folder, tokenizer_path())
    (tmp_path / "t" / "tokens-000000-0000-99999.bps").write_bytes(b"of an attempt that was lost")
    rows = sorted(token_files.read_token_files(files, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(bytes(r["ids"])))
        if r["doc_id"] is not None:
            assert ids == encode(texts[r["doc_id"]]) + [1]
        at += len(ids)
    order = [r["doc_id"] for r in rows]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:]) and len(order) == docs.count()
    named = [r["name"] for r in files.collect()]
    assert len(named) > 5 and sum(len(token_files.decode_file((tmp_path / "t" / n).read_bytes())) for n in named) == len(rows)
    assert token_files.read_token_files(token_files.write_token_files(empty, str(tmp_path / "e"), tokenizer_path()), str(tmp_path / "e")).count() == 0


def test_packing(docs, empty, texts, library):
    encode, _ = library
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = np.asarray(encode(t) + [1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        copies = 2 if i == 7 else 1
        assert sum(p["length"] for p in pieces) == len(ids) * copies and all(p["doc_tokens"] == len(ids) for p in pieces)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    used = padded = 0
    for b in bins.values():
        at = 0
        for p in sorted(b, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded <= 1.02 * used
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packer_cuts_few_documents(monkeypatch):
    rng = np.random.default_rng(4)
    packer = packing.HarmonicPacker(2048, 7 * packing.PER_WORKER, 32)
    sizes = [int(x) for x in np.clip(rng.lognormal(5.5, 1.2, 20_000), 1, 30_000)]
    rows = [r for i, n in enumerate(sizes) for r in packer.add(i, np.full(n, i, "<u4").tobytes())] + list(packer.finish())
    pieces, bins = defaultdict(list), defaultdict(list)
    for doc, start, length, _, total, sequence, offset, k in rows:
        assert total == sizes[doc] and length > 0
        pieces[doc].append((start, length))
        bins[sequence].append((offset, length, k, total, start))
    assert all(sum(n for _, n in p) == sizes[d] and [a for a, _ in p] == list(np.cumsum([0, *[n for _, n in p]])[:-1]) for d, p in ((d, sorted(p)) for d, p in pieces.items())) and len(pieces) == len(sizes)
    padding = 0
    for b in bins.values():
        used = sum(n for _, n, *_ in b)
        assert used <= 2048 and [o for o, *_ in b] == list(np.cumsum([0, *[n for _, n, *_ in b]])[:-1])
        padding += 0 if used & (used - 1) == 0 else 2048 - used
        if (k := b[0][2]) > 1:  # the class's documents come first, whole unless they are tails
            assert sum(2048 // (k + 1) < n <= 2048 // k for _, n, *_ in b[:k]) == k
    fit = [d for d, n in enumerate(sizes) if n <= 2048]
    assert sum(len(pieces[d]) > 1 for d in fit) < 0.2 * len(fit) and padding < 0.01 * sum(sizes)
    small = packing.HarmonicPacker(8, 0, 0)
    small.limit = 1
    with pytest.raises(OverflowError):
        list(small.add(1, b"\1\0\0\0" * 40))


def test_packing_of_long_batches(spark, library):
    encode, _ = library
    text = prose(random.Random(3), 400_000)  # more than a batch of Arrow holds
    rows = packing.pack(spark.createDataFrame([(1, text, "x"), (2, "ab", "y")], "doc_id long, text string, start string").coalesce(1), tokenizer_path()).collect()
    ids = np.asarray([*encode(text), 1], "<u4")
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows if r["doc_id"] == 1)


def test_quality(docs, empty, texts):
    for r in quality.judge(docs).collect():
        t, q = (texts.get(r["doc_id"]) if r["doc_id"] is not None else r["text"]) or "", r["quality"]
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)
    assert quality.clean(empty).count() == 0 and quality.clean(docs).columns == docs.columns


def test_quality_lines(spark):
    good = "This is a plain sentence of quite ordinary words, it ends well."
    bad = ["Home | About | Contact | Help", "home", "All rights reserved by somebody here.", "buy now", "#### $$$$ **** ####"]
    bad += ["." * 100 + " Menü " + " " * 100, "Alle Rechte vorbehalten bei uns allen.", "Tous droits réservés, à nous tous.", "Política de privacidad y mucho más.", "» À propos «", "see https://a.b/c and http://d.e."]
    rows = [(1, "\n".join([good] * 8 + bad)), (2, "\n".join([good + str(i) for i in range(8)] + bad)), (3, "\n".join([f"word{i} and more words {i} | a{i} | b{i}" for i in range(20)]))]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["quality"]["kept"] and got[1]["quality"]["n_dup_lines"] == 7
    assert got[2]["quality"]["cleaned"].count("\n") == 7 and not any(b in got[2]["quality"]["cleaned"] for b in bad)
    assert not got[3]["quality"]["kept"] and got[3]["quality"]["cleaned"] == ""


def test_quality_long_lines(spark):
    rng = random.Random(6)
    start, end = prose(rng, 700), prose(rng, 700) + "."
    whole = [f"{start} {mark} {end}" for mark in ("was powered by steam", "a • b • c", "a → b → c", "lorem ipsum | privacy policy | x")]
    dense = [" ".join(f"{w} |" for w in start.split()), "Lorem ipsum " * 300 + ".", prose(rng, 8) + " powered by steam.", f"{prose(rng, 5)} • {prose(rng, 5)} • {prose(rng, 5)}."]
    rows = [(k, t) for k, t in enumerate(whole)] + [(10 + k, f"{end}\n{t}\n{start}.") for k, t in enumerate(dense)]
    got = {r["doc_id"]: r["quality"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(whole):
        assert got[k]["kept"] and got[k]["cleaned"] == t, t[:50]
    for k, t in enumerate(dense):
        assert got[10 + k]["cleaned"] == f"{end}\n{start}.", t[:50]


def test_licenses(spark, docs, empty):
    texts = [
        None, "", "MIT License", "the mit license, MIT license; mit  licenses apache license", "GNU Lesser General Public License", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: BSD-3-Clause",
        "no thing here", "permit license mit-license. Public License general PUBLIC license", "MİT License mit license", "released into the public domain under CC0 1.0 license " * 50,
    ]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))), t
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[4]["labels"] == "gpl,lgpl" and rows[5]["labels"] == "apache" and rows[6]["labels"] == "bsd" and rows[5]["score"] > rows[3]["score"] > 0
    assert len(licenses.rules()) > 200
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def plain_licenses(text):
    """All rules over the whole text without keywords, each detection held against each other one."""
    g = " " + " ".join(license_words(text)) + " "
    found = [(m.start(1), m.end(1), level, n, label) for n, (label, level, p, _) in enumerate(licenses.rules()) for m in re.finditer(p, g)]
    left = [a for a in found if not any(b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[:2] == a[:2] and b[3] < a[3])) for b in found)]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in g}
    return ",".join(sorted({a[4] for a in left} | base)), max([a[2] for a in left] + [1 if base else 0]) / licenses.LEVELS, len(left)


def spellings(node):
    """All texts of a parsed pattern, with one digit for digits and one to two repetitions."""
    texts = [""]
    for op, arg in node:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg]
        elif op == "BRANCH":
            more = [t for branch in arg[1] for t in spellings(branch)]
        elif op == "SUBPATTERN":
            more = spellings(arg[3])
        else:
            assert op == "MAX_REPEAT", op
            more = [t * n for n in range(arg[0], min(arg[1], max(arg[0], 1)) + 1) for t in spellings(arg[2])]
        texts = list(dict.fromkeys(a + b for a in texts for b in more))
    return texts


def test_license_keywords_lose_no_rule():
    """Every spelling of every rule has the rule's keyword among its words."""
    shown = 0
    for label, level, pattern, key in licenses.rules():
        core = pattern.removeprefix("(?<= )").removesuffix("(?= )").removesuffix("(?= (?!licen[cs]es? ))")
        core = core[core.rindex("(?:or|and) )*") + 13 :] if level == 5 else core
        for t in spellings(re._parser.parse(core.replace("[^ ]+ ", "some ").replace("[^ ]", "x"))):
            shown += 1
            assert key in t.split(), (label, key, t)
    assert shown > 1000


def test_licenses_equal_brute_force(spark):
    """Each rule's first spelling, random mixtures and overlaps of pieces of rules, with and without what surrounds them."""
    rng = random.Random(21)
    cores = []
    for _, level, pattern, _ in licenses.rules():
        core = pattern.removeprefix("(?<= )").removesuffix("(?= )").removesuffix("(?= (?!licen[cs]es? ))")
        core = core[core.rindex("(?:or|and) )*") + 13 :] if level == 5 else core
        ways = spellings(re._parser.parse(core.replace("[^ ]+ ", "some ").replace("[^ ]", "x")))
        cores.append(("license identifier " if level == 5 else "") + rng.choice(ways))
    texts = list(cores)
    glue = ["or", "and", "with classpath exception 2 0 or", "license identifier", "licensed under", "the", "MIT", "GPL-2.0", "Apache-2.0", "General Public License", "", "lesser", "gnu", "x"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(cores).split()
            a = rng.randrange(len(w)) if rng.random() < 0.4 else 0
            parts += [*w[a : len(w) if rng.random() < 0.6 else rng.randrange(a, len(w)) + 1], rng.choice(glue)]
        texts.append(" ".join(parts))
    texts.append("mit license gnu lesser general public license " * 400)
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["labels"], round(r["score"], 9), r["n_detections"]) == (lambda x: (x[0], round(x[1], 9), x[2]))(plain_licenses(texts[r["doc_id"]])), texts[r["doc_id"]][:300]


def test_license_plan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_expressions(spark):
    cases = {
        "Released under CC0 1.0 Universal": "cc0",
        "released under Creative Commons Zero": "cc0",
        "this is a W3C Software Notice": "w3c",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache,mit",
        "licensed under MIT or Apache-2.0.": "apache,mit",
        "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND (BSD-3-Clause OR MIT)": "bsd,gpl,mit",
        "SPDX-License-Identifier: GPL-2.0-only WITH OpenSSL-exception": "gpl",
        "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR ISC": "gpl,isc",
        "SPDX-License-Identifier: LGPL-2.1-or-later\nor later json": "lgpl",
        "licensed under MIT and orange trees or mitigation": "mit",
        "licensed under BSD-3-Clause and Apache-2.0": "apache,bsd",
        "dedicated under CC0 1.0 Universal": "cc0",
        "Creative Commons Zero applies": "cc0",
        "the W3C Software and Document Notice": "w3c",
        "This is the GNU Lesser General Public License": "gpl,lgpl",
        "GNU GPL, MIT License": "gpl,mit",
        "SPDX-License-Identifier: CC-BY-SA-4.0 AND CC-BY-4.0": "cc-by,cc-by-sa",
    }
    rows = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r["doc_id"]]: r["labels"] for r in rows} == cases and all(r["score"] > 0 for r in rows)


def test_embeddings(spark, monkeypatch, scratch):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = rng.standard_normal(32)
        rows += [(len(rows) + k, (center + rng.standard_normal(32) * s).tolist(), c % 3) for k, s in enumerate([0, 0, 0.05, 0.1, 0.12, 0.15, 0.2])]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] + [1.0] * 31, 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], 0), (None, rows[0][1], 0), (n + 5, [None] + [1.0] * 31, 1), (n + 6, [1e200] * 32, 2), (n + 7, [1e-200] * 32, 2), (n + 8, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.asarray(v) / np.abs(v).max(), label) for i, v, label in rows if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = defaultdict(set)
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                linked[i].add(j)
    for block in (512, 3):
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
        got = {r["vec_id"]: r for r in embedding_dedup.near_embeddings(df, scratch).collect()}
        for i in range(n + 9):
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in linked[todo.pop()] if j not in seen and not seen.add(j)]
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(linked[i]), min(seen), i == min(seen))
        assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert embedding_dedup.near_embeddings(df.limit(0), scratch).count() == 0


def test_embeddings_of_repeated_ids_and_lengths(spark, scratch):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, v, 0, "a"), (1, v, 0, "b"), (2, w, 0, "c"), (3, [1.0, 0.0], 0, "d"), (4, [2.0, 0.0], 0, "e"), (5, [3.0], 0, "f"), (6, v, 1, "g"), (None, v, 1, "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = sorted((tuple(r) for r in embedding_dedup.near_embeddings(df, scratch).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, True)], key=repr)


def test_embeddings_suspects():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 64))
    w = v + rng.standard_normal((2000, 64)) * 0.2
    cos = (v * w).sum(1) / np.sqrt((v * v).sum(1) * (w * w).sum(1))
    bits, tables = embedding_dedup.plan(100_000, 0.98)
    apart = (embedding_dedup.signs_of(v, bits, tables) != embedding_dedup.signs_of(w, bits, tables)).sum(1)
    most = embedding_dedup.most_differing(bits * tables, 0.98)
    assert (cos >= 0.98).sum() > 500 and (apart[cos >= 0.98] <= most).all() and most < 0.3 * bits * tables


def test_scratch_scopes(spark, tmp_path):
    a, b = Scratch(spark), Scratch(spark)
    x, y = a.table(spark.range(5)), b.table(spark.range(7))
    a.close()
    assert y.count() == 7  # another scope's tables stay
    z = finished(y.where("id > 1"), b)
    assert z.count() == 5
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        x.count()
    folder = Path(b.folder.removeprefix("file://"))
    assert folder.parent.is_dir() and not folder.exists() and not Path(a.folder.removeprefix("file://")).exists()
    with pytest.raises(ZeroDivisionError), Scratch(spark) as c:
        c.table(spark.range(1))
        raise ZeroDivisionError
    assert not Path(c.folder.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sluice import session

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    shared = prose(rng, 70)
    base = [prose(rng, 90) + "." for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "s", 1), (11, "too short.", "en", "s", 1), (12, None, None, None, None), (13, shared + " " + prose(rng, 60) + ".", "en", "s", 1), (14, prose(rng, 60) + " " + shared + ".", "en", "s", 1), (15, prose(rng, 80) + " mail a@b.example now.", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"]: r for r in df.collect()})
        if k < 4:
            assert df.columns == corpus_pipeline.COLUMNS
    assert set(kept[0]) == {*range(6), 10, 13, 14, 15} and set(kept[1]) == {*range(6), 13, 14, 15} == set(kept[2]) == set(kept[3]) == set(kept[4])
    cut = brute_substring({i: r["text"] for i, r in kept[1].items()})
    assert {i: WORD.findall(r["text"]) for i, r in kept[2].items()} == {i: c[2] for i, c in cut.items()} and cut[14][1] >= 69
    assert "[EMAIL]" in kept[3][15]["text"] and kept[3][15]["n_chars"] == len(kept[3][15]["text"])
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg(F.sum("length")).first()[0] == df.agg(F.sum("length")).first()[0]
    assert len(set(folder.iterdir()) - before) == 1  # the last stage's input


def test_pipeline_of_odd_documents(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(10)
    text = prose(rng, 90) + "."
    rows = {"none": [], "odd": [(None, text, None, None, None), (None, prose(rng, 80) + ".", "en", "s", 1), (None, None, None, None, None), (3, prose(rng, 70) + ".", "en", "s", 1), (3, prose(rng, 75) + ".", "en", "s", 1)]}
    for name, r in rows.items():
        spark.createDataFrame(r, kind).coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert Counter(p["doc_id"] for p in got if p["start"] == 0) == Counter({None: 2, 3: 2} if r else {})


def test_connected_components(spark, scratch):
    from sluice.llm._graph import connected_components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 540)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
