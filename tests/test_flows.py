"""Window forms against small state machines, sources and sinks, rules and reports on Spark."""

import hashlib
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from sluice.operators import flows, http, pairing, reassembly, reports, rules, screens, terminal
from sluice.schemas import SEGMENT
from sluice.sources import capture, feeds, store

RULES = """
version: 1
defaults: {app: demo, source: tap}
rules:
  - id: login
    description: Logs in
    match:
      method: post
      path: {equals: /login}
      status: {in: [200, 201]}
      body: {jsonpath: [{path: $.result, equals: success}]}
    extract:
      user_id: {jsonpath: $.user.id}
      extra: {agent: header.User-Agent, client: query.client}
    event: {type: user.login, attributes: {channel: web}}
  - id: view
    match: {method: GET, path: {regex: '^/r/(?P<rid>[a-z0-9]+)$'}, status: 200}
    extract: {extra: {rid: path.rid}}
    event: {type: user.view}
"""


def random_segments(n, seed=3):
    rng = random.Random(seed)
    ends = [("10.0.0.1", 1000), ("10.0.0.10", 80), ("10.0.0.2", 1001), ("9.9.9.9", 23)]
    rows = []
    for i in range(n):
        a, b = rng.sample(ends, 2)
        flags = rng.choice([0, 0, 0, 16, 2, 18, 1, 4, 8])
        rows.append((i, i * 10, *a, *b, i, flags, rng.choice([b"", b"x", b"yy"])))
    return rows


def test_orientation_matches_a_state_machine(spark):
    rows = random_segments(800)
    got = {r["arrival"]: (r["client"], r["flow_seq"]) for r in flows.orient(spark.createDataFrame(rows, SEGMENT)).collect()}
    clients, closes = {}, {}
    for arrival, _, sip, sp, dip, dp, _, flags, _ in rows:
        key = frozenset([(sip, sp), (dip, dp)])
        src = f"{sip}:{sp}"
        if flags & 2 and not flags & 16:
            clients[key] = src
        client = clients.setdefault(key, src)
        assert got[arrival] == (client, closes.get((key, client), 0))
        if flags & 5:
            closes[key, client] = closes.get((key, client), 0) + 1
            del clients[key]


def test_fifo_pairs_match_a_queue(spark):
    rng = random.Random(5)
    rows = [(f"f{k}", i, rng.choice(["REQUEST", "RESPONSE"]), i) for k in range(20) for i in range(40)]
    got = sorted((r["flow_id"], r["request"]["ord"], r["response"]["ord"]) for r in pairing.http_pairs(spark.createDataFrame(rows, "flow_id string, ord long, type string, ts_us long")).collect())
    want, waiting = [], {}
    for f, i, kind, _ in rows:
        queue = waiting.setdefault(f, [])
        if kind == "REQUEST":
            queue.append(i)
        elif queue:
            want.append((f, queue.pop(0), i))
    assert got == sorted(want)


def test_assembled_and_slices_agree(spark):
    rng = random.Random(7)
    rows = []
    for f in range(12):
        text = bytes(rng.randrange(256) for _ in range(80))
        spans = [(0, 5)] + [(a, min(80, a + rng.randrange(1, 20))) for a in rng.choices(range(78), k=40)]
        rows += [(f"f{f}", k, True, a, text[a:b], k) for k, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, "flow_id string, arrival long, from_client boolean, seq long, payload binary, ts_us long")
    whole = {r["flow_id"]: bytes(r["data"]) for r in reassembly.assembled(df, ["flow_id"]).collect()}
    by_slice = {}
    for r in sorted(reassembly.slices(df).collect(), key=lambda r: r["arrival"]):
        by_slice[r["flow_id"]] = by_slice.get(r["flow_id"], b"") + bytes(r["data"])
    assert whole == by_slice


def pair(spark, request, response):
    side = "struct<data: binary, ts_us: bigint>"
    return spark.createDataFrame([("f", 1, (request.encode(), 1000), response and (response.encode(), 2000))], f"flow_id string, n long, request {side}, response {side}")


LOGIN = 'POST /login?client=web&client=app HTTP/1.1\r\nUser-Agent: a\r\n b\r\nCookie: x=1; JSESSIONID=s1\r\n\r\n{}'
OK = 'HTTP/1.1 200 OK\r\nContent-Type: application/json\r\n\r\n{"result":"success","user":{"id":"u7"}}'


def test_rules_sessions_and_events(spark):
    x = http.exchanges(pair(spark, LOGIN, OK))
    hits = rules.evaluate(x, rules.load_rules(RULES))
    (e,) = rules.user_events(hits).collect()
    assert (e["rule_id"], e["user_id"], e["session_id"], e["auth_state"], e["app"], e["source"]) == ("login", "u7", "s1", "AUTHENTICATED", "demo", "tap")
    assert e["attributes"] == {"channel": "web", "agent": "ab", "client": "app"} and e["http"]["latency_ms"] == 1
    assert "user.login" in rules.log_line(rules.user_events(hits)).first()["line"]


def test_rules_need_a_response_and_strict_json(spark):
    loaded = rules.load_rules(RULES)
    assert rules.evaluate(http.exchanges(pair(spark, LOGIN, None)), loaded).count() == 0
    assert rules.evaluate(http.exchanges(pair(spark, LOGIN, OK + " junk")), loaded).count() == 0
    (e,) = rules.evaluate(http.exchanges(pair(spark, "GET /r/ab9 HTTP/1.1\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\n")), loaded).collect()
    assert e["attributes"]["rid"] == "ab9"


def test_rule_errors():
    for text in ("version: 2", "version: 1\nrules: [{id: a, match: {method: {x: 1}}}]", "version: 1\nrules: [{id: a}, {id: a}]"):
        with pytest.raises(ValueError):
            rules.load_rules(text)
    with pytest.raises(ValueError):
        rules.json_path("$.a[*]")
    assert rules.json_path("$.a['b c'][2]") == "$['a']['b c'][2]"


def test_exchange_parts(spark):
    (x,) = http.exchanges(pair(spark, "GET /p?A=%41&b&=c&bad=%zz HTTP/1.0\r\nX: 1\r\nx: 2\r\n\r\nbody", "HTTP/1.1 abc\r\n\r\n")).collect()
    r = x["http_request"]
    assert (r["path"], r["query"], r["headers"], bytes(r["body"]), r["http_version"]) == ("/p", {"a": "A", "b": "", "bad": "%zz"}, {"x": ["1", "2"]}, b"body", "HTTP/1.0")
    assert x["http_response"]["status"] == -1
    assert http.exchanges(pair(spark, "bad", None)).count() == 0


def test_screen_rules(spark):
    loaded = screens.load_screens('version: 1\nscreens: [{id: A, match: [{position: {row: 1, column: 1, length: 20}, equals: Welcome, trim: true, ignoreCase: true}], userId: {position: {row: 2, column: 3, length: 8}, trim: true}}]')
    df = spark.createDataFrame([("WELCOME\n  BOB",), ("other",), (None,)], "plain_text string")
    got = [r["screen"] and (r["screen"]["id"], r["screen"]["user_id"]) for r in screens.first_match(df, loaded).collect()]
    assert got == [("A", "BOB"), None, None]


def test_redaction_and_operator(spark):
    df = spark.createDataFrame([({"password": "ab cdef", "x": "y"},)], "m map<string,string>")
    r = df.select(terminal.redact(F.col("m"), "pass.*").alias("m"), screens.operator_id(F.lit(None).cast("string"), F.col("m"), F.lit("X")).alias("o")).first()
    assert r["m"] == {"password": "** *def", "x": "y"} and r["o"] == "y"


def test_reports(spark):
    side = "struct<data: binary, ts_us: bigint, src: string, dst: string>"
    df = spark.createDataFrame([("txn:1", (b"GET / HTTP/1.1\r\nA:b\r\n\r\n", 1000, "1.1.1.1:5", "2.2.2.2:80"), None), ("", None, (b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(20)), 7, None, None))], f"tx_id string, request {side}, response {side}")
    r, s = reports.http_reports(df).collect()
    # The layout of reports.
    assert r["file_name"] == "1000_txn_1.http" and s["file_name"] == "7_unknown.http"
    assert r["content"] == "=== HTTP REQUEST ===\n# id: txn:1\n# timestamp_us: 1000\n# src: 1.1.1.1:5\n# dst: 2.2.2.2:80\n\nGET / HTTP/1.1\nA: b\n\n(empty body)\n\n=== HTTP RESPONSE ===\n(no response captured)\n"
    assert s["content"].endswith("HTTP/1.1 200 OK\n\n[binary payload 20 bytes]\n0000: 00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f  |................|\n0010: 10 11 12 13 " + "   " * 12 + " |....|\n")
    t, u = reports.terminal_reports(df).collect()
    assert "# dst: 2.2.2.2:80\n\n0000: 47 45 54 20" in t["content"] and t["file_name"] == "1000_txn_1.tn3270.txt"
    assert reports.terminal_reports(spark.createDataFrame([("x", (b"", 1, "a", "b"), None)], f"tx_id string, request {side}, response {side}")).first()["content"] == "=== TN3270 REQUEST ===\n# timestamp_us: 1\n# src: a\n# dst: b\n\n(empty payload)\n\n=== TN3270 RESPONSE ===\n(no response captured)\n"


def test_report_files(spark, tmp_path):
    side = "struct<data: binary, ts_us: bigint>"
    df = spark.createDataFrame([(f"t/{k}", (b"GET / HTTP/1.1\r\n\r\n", k), None) for k in range(5)], f"tx_id string, request {side}, response {side}")
    reports.write_reports(reports.http_reports(df), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}_t_{k}.http" for k in range(5)]


def frame(src, dst, sport, dport, seq, wire, payload, vlan=False):
    ip = lambda a: bytes(int(x) for x in a.split("."))
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 5 << 4, wire, 0, 0, 0) + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + ip(src) + ip(dst)
    return b"\0" * 12 + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + head + tcp + b"pad"


def test_pcap_and_filters(spark, tmp_path):
    capture.register(spark)
    frames = [frame("1.2.3.4", "5.6.7.8", 1000, 80, 2**32 - 1, 0x18, b"GET"), frame("5.6.7.8", "1.2.3.4", 23, 1001, 5, 0x12, b"", True), b"short"]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, 2, len(f), len(f)) + f for f in frames)
    (tmp_path / "a.pcap").write_bytes(data)
    s = capture.decode_frames(spark.read.format("pcap").load(str(tmp_path)))
    got = sorted(tuple(r) for r in s.drop("payload").collect())
    # A frame's arrival is its place in the file.
    assert got == [(24, 1_000_002, "1.2.3.4", 1000, "5.6.7.8", 80, 2**32 - 1, 24), (24 + 16 + len(frames[0]), 1_000_002, "5.6.7.8", 23, "1.2.3.4", 1001, 5, 18)]
    assert bytes(s.where("arrival = 24").first()["payload"]) == b"GET"
    assert s.where(capture.bpf("tcp and (port 23 or port 992)")).count() == 1 and s.where(capture.bpf("not src port 23")).count() == 1
    with pytest.raises(ValueError):
        capture.bpf("udp port 1")


def test_frames_beyond_header_fields(spark, tmp_path):
    """Ports past 16 bits and sequence numbers past 32 come back whole, from files that were rolled, in order."""
    ports = ((65535, 80), (65536, 80), (23, 129_999), (2**31 - 1, 2**31 - 1))
    rows = [(k, k * 1000, "10.0.0.1", ports[k % 4][0], "10.1.0.1", ports[k % 4][1], (2**32 - 16, 2**32, 5, 2**62)[k // 4 % 4], k % 32, b"x" * (k % 3) * 30_000) for k in range(64)]
    df = spark.createDataFrame(rows, SEGMENT).coalesce(1)
    capture.write_frames(df, str(tmp_path / "out"), every_junk=10, roll_mib=1)
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert len(names) > 1 and all(n.endswith(".pcap") for n in names)
    back = capture.decode_frames(spark.read.format("pcap").load(str(tmp_path / "out")), wide=True).orderBy("arrival").drop("arrival").collect()
    assert [(*r[:-1], bytes(r[-1])) for r in back] == [r[1:] for r in rows]


def test_frames_foreign_options():
    """Options of others leave the header's ports, and broken ones lose no frame."""
    plain = capture.encode_frame("1.2.3.4", 1, "5.6.7.8", 2, 3, 16, b"abc")
    for options in (b"\x01\x01\x01\x00", b"\xfd\x16SLUX" + bytes(16) + b"\x01\x01", b"\xfd\x16SL", b"\x02\x00\x01\x01", b"\x01\x01\x01\xfd"):
        data = bytearray(plain[:54] + options + plain[54:])
        data[16:18] = struct.pack(">H", len(data) - 14)
        data[46] = (5 + len(options) // 4) << 4
        assert capture.decode_frame(bytes(data)) == ("1.2.3.4", 1, "5.6.7.8", 2, 3, 16, b"abc")


def test_segbin_round_trip(spark, tmp_path):
    capture.register(spark)
    df = spark.createDataFrame(random_segments(50), SEGMENT).coalesce(2)
    df.write.format("segbin").mode("append").option("path", str(tmp_path / "out")).save()
    back = spark.read.format("segbin").load(str(tmp_path / "out"))
    key = lambda f: sorted(tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in f.drop("arrival").collect())
    assert key(back) == key(df)


def test_json_feed(spark):
    df = spark.createDataFrame(random_segments(20), SEGMENT)
    lines = feeds.segment_json(df, "arrival").select("value", "arrival").union(spark.createDataFrame([("not json", 99)], "value string, arrival long"))
    back = feeds.parse_segments(lines, order=F.col("arrival"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def exchange_segments(rng, conversations=4, exchanges=6):
    """Segments of exchanges in shuffled pieces, with incarnations that end by FIN, and an orphan response at each start."""
    rows, arrival = [], 0
    for c in range(conversations):
        client, server = ("10.0.0.%d" % c, 5000 + c), ("10.1.0.1", 80 if c % 2 else 9000)
        seqs = {True: 100, False: 900}

        def send(up, payload, flags=0, seqs=seqs, client=client, server=server):
            nonlocal arrival
            a, b = (client, server) if up else (server, client)
            rows.append((arrival, arrival * 10, *a, *b, seqs[up], flags, payload))
            seqs[up] += len(payload)
            arrival += 1

        for k in range(exchanges):
            if k % 3 == 0:
                send(True, b"", 2)
            request = b"POST /%d HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello" % k
            first = len(rows)
            send(True, request[:5])
            cuts = [5, *sorted(rng.sample(range(6, len(request)), 3)), len(request)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                send(True, request[x:y])
            tail = rows[first + 1 :]
            order = [r[0] for r in tail]
            rng.shuffle(tail)
            rows[first + 1 :] = [(o, *r[1:]) for o, r in zip(order, tail, strict=True)]
            send(False, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok", 1 if k % 3 == 2 else 0)
            if k % 3 == 2:
                seqs = {True: seqs[True] + 1000, False: seqs[False] + 1000}
                send.__defaults__ = (0, seqs, client, server)
    return rows


def test_segments_to_pairs_in_batch_and_stream(spark, tmp_path):
    from sluice.operators.engine import segments_to_pairs
    from sluice.streaming.flows import as_pairs, pair_stream

    rows = exchange_segments(random.Random(17))
    df = spark.createDataFrame(rows, SEGMENT)
    pairs = [r for r in segments_to_pairs(df).collect() if r["n"] is not None]
    key = lambda r: (r["flow_id"], r["n"], r["protocol"], bytes(r["request"]["data"]), r["request"]["ts_us"], bytes(r["response"]["data"]), r["response"]["ts_us"], tuple(r["client"]), tuple(r["server"]))
    batch = sorted(map(key, pairs))
    assert len(batch) == 4 * 6 and {b[2] for b in batch} == {"HTTP"} and all(b[7][0].startswith("10.0.") for b in batch)
    assert {b[3] for b in batch} == {b"POST /%d HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello" % k for k in range(6)}
    # The operators one by one give the same flows and messages.
    o = flows.orient(df)
    framed = http.frame(reassembly.slices(o)).withColumnRenamed("flow_id", "f")
    one = pairing.http_pairs(framed.select(F.col("f").alias("flow_id"), "ord", "type", "data", "ts_us"))
    assert sorted((r["flow_id"], r["n"], bytes(r["request"]["data"]), bytes(r["response"]["data"])) for r in one.collect()) == [(b[0], b[1], b[3], b[5]) for b in batch]
    for n, part in enumerate((rows[:30], rows[30:70], rows[70:])):
        spark.createDataFrame(part, SEGMENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    source = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = pair_stream(source, ttl_ms=None).writeStream.format("memory").queryName("pairs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(key, as_pairs(spark.table("pairs_out")).collect())) == batch


def test_flows_that_end_count_what_they_drop():
    from sluice.operators.engine import Conversation

    c = Conversation()
    a, b = ("1.1.1.1", 5), ("2.2.2.2", 80)
    row = lambda n, s, d, seq, flags, payload: ("c", n, *s, *d, seq, flags, payload, n)
    assert c.feed(row(0, a, b, 1, 2, b"")) == [] and c.feed(row(1, a, b, 1, 0, b"GET / HTTP/1.1\r\n")) == [] and c.held() == 16
    (lost,) = c.feed(row(2, a, b, 1, 4, b""))
    assert lost[3] is None and lost[-1] == 16 and c.held() == 0
    assert c.feed(row(3, b, a, 1, 0, b"x")) == [] and c.client == b  # whoever sends first is the client now


def test_odd_segments(spark):
    """Nulls in any column, empty payloads, repeated rows and no rows."""
    from sluice.operators.engine import segments_to_pairs

    good = (1, 5, "1.1.1.1", 5, "2.2.2.2", 80, 1, 0, b"GET / HTTP/1.1\r\n\r\n")
    answer = (2, 6, "2.2.2.2", 80, "1.1.1.1", 5, 1, 0, b"HTTP/1.1 204 x\r\n\r\n")
    rows = [good, good, answer, (3, None, "1.1.1.1", 5, "2.2.2.2", 80, None, None, b"x"), (4, 1, None, None, None, None, 1, 0, b"GET"), (None, None, None, None, None, None, None, None, None), (5, 1, "1.1.1.1", 5, "2.2.2.2", 80, 99, 0, None)]
    df = spark.createDataFrame(rows, SEGMENT).withColumn("conv", F.lit("clash")).drop("conv")
    got = segments_to_pairs(df).collect()
    assert [(r["n"], bytes(r["request"]["data"]), bytes(r["response"]["data"])) for r in got] == [(1, good[8], answer[8])]
    assert segments_to_pairs(df.limit(0)).count() == 0
    sliced = spark.createDataFrame([("f", 1, True, None, b"a", 1), ("f", 2, True, 5, None, 1), (None, 3, None, 5, b"b", None)], "flow_id string, arrival long, from_client boolean, seq long, payload binary, ts_us long")
    assert [(r["flow_id"], bytes(r["data"])) for r in reassembly.slices(sliced).collect()] == [(None, b"b")]


def test_stream_gives_up_silent_conversations(spark, tmp_path):
    from sluice.streaming.flows import pair_stream

    spark.createDataFrame([(0, 1, "1.1.1.1", 5, "2.2.2.2", 80, 1, 0, b"GET / HTTP/1.1\r\n")], SEGMENT).write.parquet(str(tmp_path / "in"))
    stream = pair_stream(spark.readStream.schema(SEGMENT).parquet(str(tmp_path / "in")), ttl_ms=1000)
    q = stream.writeStream.format("memory").queryName("silent_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got, end = [], time.monotonic() + 90
    while not got and time.monotonic() < end:
        time.sleep(1)
        got = spark.table("silent_out").collect()
    q.stop()
    assert [r["dropped_bytes"] for r in got] == [16]


def test_index_and_blobs(spark, tmp_path):
    import json

    (tmp_path / "blob-1.seg").write_bytes(b"HEADbody!")
    entry = {"id": "a", "kind": "REQUEST", "headers_blob": "blob-1.seg", "headers_off": 0, "headers_len": 4, "body_blob": "none.seg", "body_off": 4, "body_len": 5}
    (tmp_path / "index-1.ndjson").write_text(json.dumps(entry) + "\nnot json\n" + json.dumps(entry | {"id": "b", "body_blob": "blob-1.seg"}) + "\n")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["id"]: (bytes(r["headers"]), bytes(r["body"])) for r in store.with_blobs(store.read_index(spark, folder), folder).collect()}
        assert got == {"a": (b"HEAD", b""), "b": (b"HEAD", b"body!")}


MESSAGES = "flow_id string, ord long, type string, data binary, ts_us long, tx_id string, src string, dst string, protocol string"


def stored(spark, folder):
    return {r["id"]: r for r in store.with_blobs(store.read_index(spark, folder), folder).collect()}


def test_store_rolls_and_is_written_again(spark, tmp_path):
    rows = [(f"f{k % 3}", k, "REQUEST", b"GET /%d HTTP/1.1\r\nA: b\r\n\r\nbody%d" % (k, k), k, f"t{k}", "a", "b", "HTTP") for k in range(30)] + [("f0", 99, "REQUEST", b"no end", 1, None, None, None, "HTTP"), ("f0", 100, "RESPONSE", None, 1, "", None, None, "TN3270")]
    m = spark.createDataFrame(rows, MESSAGES)
    folder = str(tmp_path / "store")
    files = store.write_store(m, folder, 100)
    assert files.count() > 5 and {p.suffix for p in (tmp_path / "store").iterdir()} == {".ndjson", ".seg", ""}
    got = stored(spark, folder)
    assert len(got) == 32 and bytes(got["t7"]["headers"]) == b"GET /7 HTTP/1.1\r\nA: b\r\n\r\n" and bytes(got["t7"]["body"]) == b"body7" and got["t7"]["first_line"] == "GET /7 HTTP/1.1"
    assert bytes(got[None]["headers"]) == b"no end" and got[None]["body_len"] == 0 and got[""]["kind"] == "RESPONSE" and got[""]["first_line"] == ""
    # A second job adds to the store, and the first one's bytes stay; its name sorts after the first one's.
    more = [("f0", 1, "RESPONSE", bytes(range(n)), 1, f"u{n}", None, None, "TN3270") for n in (16, 17)]
    store.write_store(spark.createDataFrame(more, MESSAGES), folder)
    both = stored(spark, folder)
    assert len(both) == 34 and bytes(both["t7"]["body"]) == b"body7" and (both["u16"]["first_line"], both["u17"]["first_line"]) == (bytes(range(16)).hex(), bytes(range(16)).hex() + "...")
    assert min(r["arrival"] for k, r in both.items() if k in ("u16", "u17")) > max(r["arrival"] for k, r in both.items() if k not in ("u16", "u17"))
    # Files of others are read beside them.
    (tmp_path / "store" / "index-1.ndjson").write_text('{"id": "own", "kind": "RSP", "body_blob": "none.seg", "body_off": 0, "body_len": 5}\n')
    assert stored(spark, folder)["own"]["kind"] == "RESPONSE" and len(stored(spark, folder)) == 35
    assert store.write_store(m.limit(0), str(tmp_path / "none")).count() == 0


def test_store_reads_no_batch_twice(spark, tmp_path):
    folder = str(tmp_path / "store")
    m = spark.createDataFrame([("f", k, "REQUEST", b"x%d" % k, 1, f"t{k}", None, None, "TN3270") for k in range(4)], MESSAGES)
    # A batch whose tasks have written their files, and which fails before its commit.
    m.select("flow_id", "type", "data", "ts_us", "tx_id", "src", "dst", "protocol").mapInArrow(store._blobs(folder, "live_000000000000", 100), store.FILES).collect()
    assert list((tmp_path / "store").glob("index-*")) and stored(spark, folder) == {}
    for k in range(4):
        m.where(F.col("ord") == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has other checkpoints, so it gives all batches again
        store.store_stream(source, folder, "live").option("checkpointLocation", str(tmp_path / f"cp{_}")).trigger(availableNow=True).start().awaitTermination(120)
        got = store.with_blobs(store.read_index(spark, folder), folder).collect()
        assert sorted((r["id"], bytes(r["body"])) for r in got) == [(f"t{k}", b"x%d" % k) for k in range(4)]


def test_pair_json_sides(spark):
    side = "struct<data: binary, ts_us: bigint, attributes: map<string,string>>"
    end = "struct<ip: string, port: int>"
    rows = [("t\"1", (b'GET /"x" HTTP/1.1\r\nA: \t b\r\n\r\n\xff\x00', 5, {"k": 'v"'}), None, ("c", 1), ("s", 80)), ("t2", None, (b"HTTP/1.1 200 OK", 7, {}), None, ("s", 80))]
    df = spark.createDataFrame(rows, f"tx_id string, request {side}, response {side}, client {end}, server {end}")
    import json

    a, b = (json.loads(r["value"]) for r in feeds.pair_json(df, "HTTP").collect())
    # Fields of the bus's pairs.
    assert a == {"protocol": "HTTP", "txId": 't"1', "startTs": 5, "endTs": 5, "client": {"ip": "c", "port": 1}, "server": {"ip": "s", "port": 80}, "response": None} | {"request": {"timestamp": 5, "direction": "REQUEST", "length": 31, "firstLine": 'GET /"x" HTTP/1.1', "headers": 'GET /"x" HTTP/1.1\r\nA: \t b', "bodyB64": "/wA=", "metadataTxId": 't"1', "attributes": {"k": 'v"'}}}
    assert b["request"] is None and b["client"] == {"ip": "", "port": 0} and "attributes" not in b["response"] and b["response"]["bodyB64"] == ""
    t = json.loads(feeds.pair_json(df, "TN3270").first()["value"])
    assert t["request"].keys() == {"timestamp", "direction", "length", "payloadB64", "attributes"}


def test_terminal_json_envelope(spark):
    import json

    f = "array<struct<start: int, length: int, protected: boolean, numeric: boolean, hidden: boolean, value: string>>"
    rows = [("s", 0, "SESSION_START", 1000, None, None, None, None, None, None, None, None, "k"), ("s", 1, "SCREEN_RENDER", 1001, None, None, 24, 80, "x", [(1, 2, True, False, False, "A")], "h", "N", "k"), ("s", 2, "USER_SUBMIT", 1002, None, {}, None, None, None, None, "h", "N", "k")]
    df = spark.createDataFrame(rows, f"session_id string, n long, type string, ts_us long, aid string, inputs map<string,string>, rows int, cols int, plain_text string, fields {f}, screen_hash string, screen_name string, session_key string")
    out = [(r["topic"], r["key"], json.loads(r["value"])) for r in feeds.terminal_json(df, host="me").collect()]
    assert [o[0] for o in out] == ["user-actions", "screen-renders", "user-actions"] and all(o[1] == "k" for o in out)
    start, render, submit = (o[2] for o in out)
    # Parts of the envelope by type of event.
    assert list(start) == ["schemaVersion", "eventId", "emittedAt", "type", "session", "tn3270", "pipeline"] and start["tn3270"] == {} and start["session"] == {"sessionKey": "k", "sessionId": "s"} and start["pipeline"]["host"] == "me"
    assert render["tn3270"] == {"rows": 24, "cols": 80, "screenHash": "h", "screenName": "N", "fields": [{"start": 1, "length": 2, "protected": True, "numeric": False, "hidden": False, "value": "A"}]}
    assert submit["tn3270"] == {"aid": "UNKNOWN", "screenHash": "h", "screenName": "N", "inputs": {}}
    ids = [o[2]["eventId"] for o in out]
    assert len(set(ids)) == 3 and all(len(i) == 26 and not set(i) & set("ILOU") for i in ids) and start["emittedAt"].endswith("Z")


def test_filter_policy():
    assert capture.allowed_filter("tcp") == "tcp" and capture.allowed_filter("src port 1", custom=True) == "src port 1"
    for text, custom in (("src port 1", False), ("tcp; rm", True), ("tcp `x`", True)):
        with pytest.raises(ValueError):
            capture.allowed_filter(text, custom)


def test_charsets(spark):
    rows = [("é".encode("cp1252"), 'text/plain; charset="windows-1252"'), ("日本".encode("shift_jis"), "x; charset=Shift_JIS"), ("é".encode(), "x; charset=nope"), ("é".encode(), None), ("é".encode("utf-16"), "x;charset=utf-16"), (None, None)]
    df = spark.createDataFrame(rows, "b binary, c string")
    assert [r[0] for r in df.select(http.body_text(F.col("b"), F.col("c"))).collect()] == ["é", "日本", "é", "é", "é", None]


def test_deflate_bodies():
    import zlib

    from sluice.operators.reports import decode_message

    packed = zlib.compress(b"hello")
    assert decode_message(b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + packed).endswith(b"Content-Length: 5\r\n\r\nhello")


def test_session_of_two_clients(spark):
    side = "struct<data: binary, ts_us: bigint>"
    rows = [("f", n, (b"GET / HTTP/1.1\r\nUser-Agent: a\r\n\r\n", 5), (b"HTTP/1.1 200 OK\r\n\r\n", 6), (ip, 1)) for n, ip in enumerate(("1.1.1.1", "2.2.2.2", " 1.1.1.1 "))]
    x = http.exchanges(spark.createDataFrame(rows, f"flow_id string, n long, request {side}, response {side}, client struct<ip: string, port: int>"))
    import hashlib

    got = [r[0] for r in x.orderBy("n").select(rules.session(user_id=F.lit(None))[0]).collect()]
    want = ["DERIVED-" + hashlib.sha256(f"{ip}|a|0".encode()).hexdigest()[:24].upper() for ip in ("1.1.1.1", "2.2.2.2", "1.1.1.1")]
    assert got == want


def test_totals_and_predicates(spark):
    from sluice.operators import detect, metrics

    df = spark.createDataFrame([("a", 5), ("a", 7), ("b", None)], "k string, w long")
    assert {r["metric"]: (r["waits"], r["total"]) for r in metrics.waits(df, "k", F.col("w")).collect()} == {"a": (2, 12), "b": (0, 0)}
    index = spark.createDataFrame([(4,), (0,), (None,)], "headers_len long")
    assert detect.index_entries_of(index, "HTTP").count() == 1 and detect.index_entries_of(index, "TN3270").count() == 2


def test_samples(spark, tmp_path):
    (tmp_path / "x-request.txt").write_text("GET /r/a1 HTTP/1.1\nReferer: z\n\n")
    (tmp_path / "x-response.txt").write_text("HTTP/1.1 200 OK\n\n")
    (tmp_path / "y-request.txt").write_text("GET /q HTTP/1.1\n\n")
    got = {r["flow_id"]: r["latency_us"] for r in http.exchanges(feeds.samples(spark, str(tmp_path))).collect()}
    assert got == {"x": 1000, "y": -1}


def test_settings(tmp_path):
    from sluice.sources.config import Watched, merge, parse_arguments

    with pytest.warns(UserWarning):
        assert merge("live", {"a": "1", "b": "2"}, "common: {b: 3, c: {d: 4}}\nlive: {a: 5}", {"a": "6"}) == {"a": "6", "b": "3", "c.d": "4"}
    assert parse_arguments(["x=1=2"]) == {"x": "1=2"}
    with pytest.raises(ValueError):
        parse_arguments(["x"])
    p = tmp_path / "r.yaml"
    p.write_text(RULES)
    w = Watched([str(p)], rules.load_rule_files)
    w.looked -= 10
    p.write_text("version: 1")
    assert len(w.value["rules"]) == 2 and w()["rules"] == []


def test_bus_pairs(spark):
    import base64
    import json

    body = base64.b64encode(b"3\r\nabc\r\n0\r\n\r\n").decode()
    line = json.dumps({"txId": "t", "request": {"firstLine": "GET /", "attributes": {"a": "1"}}, "response": {"firstLine": "HTTP/1.1 200 OK", "headers": "Transfer-Encoding: chunked", "bodyB64": body}})
    p = feeds.parse_pairs(spark.createDataFrame([(line,), ("broken",)], "value string"))
    assert [r["content"] for r in feeds.pair_reports(p, True).collect()] == ["HTTP REQUEST\nGET /\nHTTP RESPONSE\nHTTP/1.1 200 OK\nabc\n# attrs: a=1\n"]


def test_session_extractor_and_terminal_events(spark):
    from sluice.functions import ebcdic

    df = spark.createDataFrame([({"x-tok": ["v=77"], "cookie": ["a=1; SID = s9"]}, ["Sid=zz; Path=/"])], "h map<string,array<string>>, s array<string>")
    r = df.select(rules.extract_session(F.col("h"), ["x-tok: v=(\\d+)"], ["sid"]).alias("a"), rules.extract_session(F.col("h"), ["nope(.)"], ["sid"]).alias("b"), rules.extract_set_session(F.col("s"), ["sid"]).alias("c")).first()
    assert tuple(r) == ("HDR:77", "SID:s9", "SID:zz")
    write = bytes([0xF5, 0x40]) + ebcdic.encode("Welcome") + bytes([0x11, 0x40, 0x4A, 0x1D, 0x20]) + ebcdic.encode("ID:") + bytes([0x1D, 0x40]) + ebcdic.encode("    ")
    submit = bytes([0x7D, 0x40, 0x40, 0x11, 0x40, 0x4F]) + ebcdic.encode("BOB")
    side = "struct<data: binary, ts_us: bigint>"
    pairs = spark.createDataFrame([("f", 1, (submit, 2000), (write, 1000))], f"flow_id string, n long, request {side}, response {side}")
    loaded = screens.load_screens("version: 1\nscreens: [{id: A, match: [{position: {row: 1, column: 1, length: 7}, equals: Welcome}]}]")
    events = screens.terminal_user_events(terminal.terminal_events(pairs), loaded)
    (e,) = events.collect()
    assert e["operator_id"] == "BOB" and e["attributes"]["screen.id"] == "A" and e["attributes"]["input.id"] == "BOB" and e["attributes"]["tn3270.aid"] == "ENTER"
    assert "operator=BOB" in screens.log_line(events).first()["line"]


def test_ema_folds_without_an_array(spark):
    from sluice.operators import metrics

    rows = [("hot", k, float(k * 7919 % 101)) for k in range(25000)] + [("zero", 1, 0.0), ("zero", 2, 4.0), ("zero", 3, 8.0), ("null", 1, 1.0), ("null", 2, None), ("null", 3, 2.0), (None, 1, 5.0)]
    got = metrics.ema(spark.createDataFrame(rows, "k string, o long, v double"), "k", "o", "v")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    hot = 0.0
    for _, _, v in rows[:25000]:
        hot = v if hot == 0 else 0.85 * hot + (1 - 0.85) * v
    assert {r["metric"]: r["ema"] for r in got.collect()} == {"hot": hot, "zero": 0.85 * 4.0 + (1 - 0.85) * 8.0, "null": None, None: 5.0}
    assert metrics.ema(spark.createDataFrame([], "k string, o long, v double"), "k", "o", "v").count() == 0


def plain_murmur(data):
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) % 2**64
    first = lambda k: rot(k * 0x87C37B91114253D5 % 2**64, 31) * 0x4CF5AD432745937F % 2**64
    second = lambda k: rot(k * 0x4CF5AD432745937F % 2**64, 33) * 0x87C37B91114253D5 % 2**64
    a = b = 0
    for at in range(0, len(data) // 16 * 16, 16):
        j, k = struct.unpack_from("<QQ", data, at)
        a = ((rot(a ^ first(j), 27) + b) * 5 + 0x52DCE729) % 2**64
        b = ((rot(b ^ second(k), 31) + a) * 5 + 0x38495AB5) % 2**64
    j, k = struct.unpack("<QQ", data[len(data) // 16 * 16 :].ljust(16, b"\0"))
    a, b = a ^ first(j) ^ len(data), b ^ second(k) ^ len(data)
    a = (a + b) % 2**64
    both = [a, (a + b) % 2**64]
    for i, h in enumerate(both):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor % 2**64
        both[i] = h ^ h >> 33
    a = sum(both) % 2**64
    return struct.pack("<QQ", a, (a + both[1]) % 2**64).hex()


def test_murmur_of_each_event(spark, tiny):
    from sluice.functions import binary

    events = spark.read.parquet(f"{tiny}/events.parquet").select("props", binary.murmur128(F.col("props").cast("binary")).alias("h")).collect()
    assert events and all(r["h"] == plain_murmur(r["props"].encode()) for r in events)
    assert all(binary.murmur128_hex(bytes(range(n))) == plain_murmur(bytes(range(n))) for n in range(70))


class Lines:
    """A protocol of lines: a message is what a line feed ends."""

    def __init__(self, from_client):
        self.rest = b""

    def feed(self, data):
        *whole, self.rest = (self.rest + data).split(b"\n")
        return whole

    def held(self):
        return len(self.rest)


def test_protocols_of_ones_own():
    from sluice.operators.engine import Conversation
    from sluice.operators.protocols import KNOWN, Protocol, recognise

    lines = Protocol("LINES", (7,), lambda b: b.startswith(b"!"), Lines, drops_orphans=False)
    assert recognise(80, b"").name == "HTTP" and recognise(9, b"GET /") is KNOWN[0] and recognise(9, b"\xff").name == "TN3270" and recognise(9, b"GET \xff") is None and recognise(9, b"!", (*KNOWN, lines)) is lines
    c = Conversation(protocols=(*KNOWN, lines))
    row = lambda n, up, seq, payload: ("c", n, *(("a", 1, "b", 9) if up else ("b", 9, "a", 1)), seq, 0, payload, n)
    assert c.feed(row(0, True, 0, b"!one\ntw")) == [] and c.feed(row(1, False, 0, b"yes\n"))[0][2:6] == ("LINES", 1, {"data": b"!one", "ts_us": 0}, {"data": b"yes", "ts_us": 1})
    assert c.held() == 2
    off = Conversation(enabled=("HTTP",), protocols=(lines,))
    assert off.feed(row(0, True, 0, b"!one\n")) == [] and off.feed(row(1, False, 0, b"yes\n")) == []


def test_runs_side_by_side(spark):
    from sluice.plans.runs import run_all

    assert run_all(spark, {"a": lambda: spark.range(5).count(), "b": lambda: 2}) == {"a": 5, "b": 2} and run_all(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        run_all(spark, {"a": lambda: 1 / 0, "b": lambda: spark.range(10).count()})


def test_switches_and_bounds(spark):
    from sluice.sources.config import checked
    from sluice.streaming.flows import discard

    with pytest.raises(RuntimeError):
        feeds.disabled(spark, "a int", start=True)
    assert feeds.disabled(spark, "a int").count() == 0
    side = "struct<data: binary, ts_us: bigint>"
    pairs = spark.createDataFrame([("f", 1, (b"\x7d", 1), (b"", 2))], f"flow_id string, n long, request {side}, response {side}")
    assert terminal.terminal_events(pairs, enabled=False).count() == 0 and terminal.terminal_events(pairs).count() == 3
    discard(pairs)
    assert checked({"snaplen": "64", "x": "y"}) == {"snaplen": "64", "x": "y"}
    for bad in ({"snaplen": "63"}, {"workers": "33"}, {"rollMiB": "7"}, {"queueCapacity": "\xb2"}):
        with pytest.raises(ValueError):
            checked(bad)


def test_java_white_space_and_repeated_headers(spark):
    from sluice.operators import http as h

    request = b"GET /a HTTP/1.1\r\nHost:\th\t\r\nX\t: \x1f1\r\nCookie: a=1; b=\t2\r\nCookie:\tJSESSIONID=\ts1\t;a=3\r\n\r\n"
    response = b"HTTP/1.1 200 OK\r\nSet-Cookie: SMSESSIONID=; Path=/\r\nSet-Cookie: =x\r\nSet-Cookie: smsessionid =\tok ;x\r\n\r\n"
    pair = "struct<data: binary, ts_us: bigint>"
    df = spark.createDataFrame([("f", 1, (request, 1), (response, 2)), ("g", 1, (b"GET / HTTP/1.1\r\n\r\n", 1), (response, 2))], f"flow_id string, n bigint, request {pair}, response {pair}")
    x = h.exchanges(df)
    sid, state = rules.session(client_ip=F.lit("1.1.1.1"))
    f, g = x.select("*", sid.alias("sid"), state.alias("state")).orderBy("flow_id").collect()
    assert f.http_request.headers["host"] == ["h"] and f.http_request.headers["x"] == ["1"]
    assert f.http_request.cookies == {"a": "3", "b": "2", "jsessionid": "s1"} and (f.sid, g.sid, g.state) == ("s1", "ok", "AUTHENTICATED")
    loaded = rules.load_rules("version: 1\nrules: [{id: r, match: {headers: {Host: {equals: h}}}, extract: {extra: {x: header.X}}, event: {attributes: {app: ' ', source: mine}}}]")
    (m,) = rules.user_events(rules.evaluate(x, loaded), defaults={"app": "demo", "source": "gateway"}).collect()
    assert (m.app, m.source, m.attributes) == ("demo", "mine", {"x": "1"})


def test_json_paths():
    assert rules.json_path(" $.a [ 0 ]['b c'][\"it's\"]\n.d['say \\\\ x'] ") == "$['a'][0]['b c'][\"it's\"]['d']['say \\ x']"
    assert rules.json_path(r"$['a\'b']") == "$[\"a'b\"]"
    for bad in ("a", "", "$x", "$.", "$[", "$[-1]", "$['a]", "$[1", "$['a' b]", "$..a"):
        with pytest.raises(ValueError):
            rules.json_path(bad)


def test_terminal_attributes_of_any_letters(spark):
    from sluice.operators import screens as sc

    inputs = {"USER:": "a", "USER": " b\x85c\n ", "\u00c9TAT CIVIL": "x", "--": "gone", "\u0130\u03a3 \u0663": None, "k" * 63 + "-x": "cut"}
    kinds = "screen struct<id: string, description: string, label: string>, inputs map<string,string>"
    (got,) = spark.createDataFrame([(("S", " ", ""), inputs)], kinds).select(sc.terminal_attributes(F.col("screen"), F.lit(None).cast("string"), F.col("inputs"), F.lit(" "), F.lit("h"), F.lit(24), F.lit(80)).alias("a")).collect()
    assert got.a == {"screen.id": "S", "screen.hash": "h", "screen.rows": "24", "screen.cols": "80", "input.user": "b c", "input.\u00e9tat_civil": "x", "input.i\u03c3_\u0663": "", "input." + "k" * 63: "cut"}
    (op,) = spark.createDataFrame([({"USER": " ", "user:": "joe", "z": "q"},)], "inputs map<string,string>").select(sc.operator_id(F.lit(" "), F.col("inputs"), F.lit("USER")).alias("o")).collect()
    assert op.o == "joe"


def test_rectangles_end_at_the_right_edge(spark):
    from sluice.operators import screens as sc

    text = ("x" * 78 + "AB") + "\r\nCD\rEF"
    at = lambda row, column, length, **more: {"position": {"row": row, "column": column, "length": length}, **more}
    cut = lambda *a, **k: sc.rectangle(F.col("t"), at(*a, **k), F.lit(4), F.lit(80))
    (r,) = spark.createDataFrame([(text,)], "t string").select(cut(1, 79, 5), cut(2, 1, 4), cut(3, 1, 2), cut(4, 1, 2), cut(5, 1, 2), cut(2, 80, 2), cut(2, 81, 2), cut(2, 1, 4, trim=True)).collect()
    assert tuple(r) == ("AB", "CD  ", "EF", "  ", "", " ", "", "CD")


def test_frames_of_length_0_and_forged_options():
    data = bytearray(capture.encode_frame("1.2.3.4", 1, "5.6.7.8", 2, 3, 1, b"abc"))
    data[16:18] = b"\0\0"
    assert capture.decode_frame(bytes(data)) == ("1.2.3.4", 1, "5.6.7.8", 2, 3, 1, b"")
    wide = capture.encode_frame("1.2.3.4", 70_000, "5.6.7.8", 2, 1 << 40, 16, b"abc")
    assert capture.decode_frame(wide) == ("1.2.3.4", 70_000 & 0xFFFF, "5.6.7.8", 2, 0, 16, b"abc")
    assert capture.decode_frame(wide, wide=True) == ("1.2.3.4", 70_000, "5.6.7.8", 2, 1 << 40, 16, b"abc")


def test_regroup_against_a_machine(spark):
    from sluice.operators import reports as rp

    rng = random.Random(31)
    rows = [(f"t{t}", k, rng.choice(["REQUEST", "RESPONSE"])) for t in range(60) for k in range(rng.randrange(1, 25))] + [(None, 1, "REQUEST"), (None, 2, "RESPONSE"), (None, 3, "RESPONSE")]
    want = set()
    for tx in {r[0] for r in rows}:
        use, held = 1, {}
        for _, k, kind in sorted(r for r in rows if r[0] == tx):
            held[kind] = k
            if len(held) == 2:
                want.add((tx, use, held["REQUEST"], held["RESPONSE"]))
                use, held = use + 1, {}
        if held:
            want.add((tx, use, held.get("REQUEST"), held.get("RESPONSE")))
    got = rp.regroup(spark.createDataFrame(rows, "tx_id string, ord int, type string").repartition(5))
    assert {(r.tx_id, r.use, r.request and r.request.ord, r.response and r.response.ord) for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning(tx_id") == 1
    assert rp.regroup(spark.createDataFrame([], "tx_id string, ord int, type string")).count() == 0


def nested_captures(rng, n=300):
    """Segments, many of which carry pieces or the whole of other captures, or zeros."""
    rows = random_segments(n)
    inner = {
        ".segbin": capture.SEGBIN_MAGIC + b"".join(capture.segment_record(*r[1:]) for r in rows[:3]),
        ".pcap": b"".join(struct.pack("<IIII", 5, 6, 90, 90) + capture.encode_frame("9.9.9.9", 1, "8.8.8.8", 2, 3, 0, b"x" * 36) for _ in range(12)),
    }
    out = []
    for k, r in enumerate(rows):
        some = rng.choice([*inner.values(), bytes(200), b""])
        payload = rng.choice([r[8], some, some[rng.randrange(len(some) + 1) :], some[4:], some * 2])
        out.append((*r[:8], payload[:1500]))
    return out


@pytest.mark.parametrize("kind", ["segbin", "pcap"])
def test_splits_give_the_same_rows(spark, tmp_path, kind):
    rng = random.Random(41)
    capture.register(spark)
    df = spark.createDataFrame(nested_captures(rng), SEGMENT).coalesce(2)
    out = str(tmp_path / "out")
    df.write.format(kind).mode("append").option("path", out).save()
    load = lambda **o: spark.read.format(kind).options(**o).load(out)
    key = lambda f: [tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in f.orderBy("arrival").collect()]
    whole = key(load(splitMiB=0))
    assert len(whole) == 300 and len({r[0] for r in whole}) == 300
    for size in (700, 5_000, 70_001):
        split = load(splitBytes=size, maxRecord=2_000)
        assert key(split) == whole
        assert split.rdd.getNumPartitions() > 100_000 // size
    assert spark.read.format(kind).load(str(tmp_path / "none")).count() == 0


def test_splits_that_disagree_are_an_error():
    """Records that lead past their neighbours on purpose: whoever reads before the split sees it."""
    import io

    from sluice.sources import records

    class At(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    record = lambda payload: capture.segment_record(1, "1.1.1.1", 1, "2.2.2.2", 2, 3, 0, payload)
    good = [record(b"a" * 60) for _ in range(8)]
    # From inside the third record a false one reaches to the end of the fourth.
    tail = 8 + len(good[3])
    false = capture.segment_record(1, "1.1.1.1", 1, "2.2.2.2", 2, 3, 0, bytes(tail))[: -tail]
    good[2] = record(b"b" * 40 + false + bytes(8))
    data = capture.SEGBIN_MAGIC + b"".join(good)
    form = records.form_of(At(data), ".segbin")
    whole = [at for at, _, _ in form.records(At(data), 0, len(data), len(data), 200)]
    assert len(whole) == 8
    split = whole[3] - 4  # in the third record's payload, behind the false header
    with pytest.raises(ValueError, match="whole"):
        list(form.records(At(data), 0, split, len(data), 45))
    assert [at for at, _, _ in form.records(At(data), 0, split, len(data), 1000)] == whole[:3]


def test_filters_reach_the_scan(spark, tmp_path):
    capture.register(spark)
    rows = random_segments(80)
    df = spark.createDataFrame(rows, SEGMENT).coalesce(1)
    for kind in ("segbin", "pcap"):
        out = str(tmp_path / kind)
        df.write.format(kind).mode("append").option("path", out).save()
        text = "tcp and (port 80 or not src host 10.0.0.1)"
        scanned = spark.read.format(kind).option("filter", text).load(out)
        every = spark.read.format(kind).load(out)
        decoded = lambda f, kind=kind: capture.decode_frames(f) if kind == "pcap" else f
        key = lambda f: sorted(map(str, f.collect()))
        assert 0 < scanned.count() < 80 and key(decoded(scanned)) == key(decoded(every).where(capture.bpf(text)))
        some = spark.read.format(kind).option("sinceUs", 50).option("untilUs", 400).load(out)
        assert 0 < some.count() < 80 and key(some) == key(every.where("ts_us >= 50 AND ts_us < 400"))
        assert every.where("ts_us = 50").count() == 1 and every.count() == 80  # one query's filter isn't the next one's
    with pytest.raises(Exception, match="unsupported filter word"):
        spark.read.format("segbin").option("filter", "udp port 1").load(str(tmp_path / "segbin")).count()


def test_captures_as_streams(spark, tmp_path):
    """Files to pairs, with a stop between: each pair once, and those of the batch."""
    from sluice.operators.engine import segments_to_pairs
    from sluice.streaming.flows import as_pairs, pair_stream

    capture.register(spark)
    rows = exchange_segments(random.Random(17))
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    key = lambda r: (r["flow_id"], r["n"], bytes(r["request"]["data"]), r["request"]["ts_us"], bytes(r["response"]["data"]), r["response"]["ts_us"])
    batch = sorted(key(r) for r in segments_to_pairs(spark.createDataFrame(rows, SEGMENT)).collect() if r["n"] is not None)
    for part in (rows[:30], rows[30:70], rows[70:]):
        spark.createDataFrame(part, SEGMENT).coalesce(1).write.format("segbin").mode("append").option("path", files).save()
        s = spark.readStream.format("segbin").load(files)
        q = pair_stream(s, ttl_ms=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(key, as_pairs(spark.read.parquet(out)).collect())) == batch
    reader = capture._Stream(capture.SegbinReader({"path": files}), {"maxbytes": 1})
    assert reader.initialOffset()["files"] == 0
    for n in (1, 2, 3, 3):
        end = reader.latestOffset()
        assert end["files"] == n and reader.partitions({"files": 0, "last": ""}, end)
    (tmp_path / "in" / "a.segbin").write_bytes(capture.SEGBIN_MAGIC)
    with pytest.raises(RuntimeError):
        reader.partitions({"files": 0, "last": ""}, end)


def test_streams_write_captures_once(spark, tmp_path):
    capture.register(spark)
    rows = random_segments(40)
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], SEGMENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    out = str(tmp_path / "out")
    key = lambda f: sorted(map(str, f.drop("arrival").collect()))
    want = key(spark.createDataFrame(rows, SEGMENT))
    source = lambda: spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run comes with the first one's batches again
        source().writeStream.format("segbin").option("path", out).option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start().awaitTermination(120)
        assert key(spark.read.format("segbin").load(out)) == want
    # A batch that failed after its files were written: no list names them.
    (tmp_path / "out" / "part-stream-0-9-00000-0-0000.segbin").write_bytes(capture.SEGBIN_MAGIC + capture.segment_record(*rows[0][1:]))
    assert key(spark.read.format("segbin").load(out)) == want
    spark.createDataFrame(rows[:1], SEGMENT).write.format("segbin").mode("append").option("path", out).save()
    assert spark.read.format("segbin").load(out).count() == 41


def test_state_is_written_by_piece():
    """What a batch doesn't touch is not written again."""
    from sluice.operators.engine import Conversation
    from sluice.streaming._state import put_together, taken_apart

    c, rng = Conversation(), random.Random(3)
    a, b = ("1.1.1.1", 5), ("2.2.2.2", 80)
    row = lambda n, seq, payload, s=a, d=b: ("c", n, *s, *d, seq, 0, payload, n)
    c.feed(row(0, 0, b"POST / HTTP/1.1\r\nContent-Length: 400000\r\n\r\n"))
    written, parts = [], {}
    for k in range(200):  # a gap after the head: all of these wait
        c.feed(row(k + 1, 1000 + 1500 * k, rng.randbytes(1400)))
        core, now = taken_apart(c)
        written.append(sum(len(v) for n, v in now.items() if n not in parts))
        parts = now
        c = put_together(core, parts)
    assert written[50:] == [1400] * 150 and c.held() > 200 * 1400
    assert len(core) < 60 * 200 + 2000
    from sluice.operators.terminal import RecordFramer

    f, size = RecordFramer(), 0
    for _ in range(40):
        f.feed(bytes(1000))
        core, now = taken_apart(f)
        f = put_together(core, now)
        size += 1000
        assert f.held() == size
    assert len(core) < 2000


def test_disordered_batches_give_the_pairs_of_ordered_ones(spark, tmp_path):
    from sluice.operators.engine import segments_to_pairs
    from sluice.streaming.flows import as_pairs, pair_stream

    rng = random.Random(18)
    rows = [(r[0] * 1000, *r[1:]) for r in exchange_segments(rng)]
    key = lambda r: (r["flow_id"], r["n"], bytes(r["request"]["data"]), r["request"]["ts_us"], bytes(r["response"]["data"]), r["response"]["ts_us"])
    batch = sorted(key(r) for r in segments_to_pairs(spark.createDataFrame(rows, SEGMENT)).collect() if r["n"] is not None)
    # Each row comes up to 40,000 arrivals late; the last one, of another conversation, lets all others go.
    mixed = sorted(rows, key=lambda r: r[0] + rng.randrange(40_000))
    parts = [mixed[k : k + 25] for k in range(0, len(mixed), 25)] + [[(10_000_000, 1, "9.9.9.9", 1, "8.8.8.8", 2, 1, 0, b"x")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SEGMENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n:02d}"))
        time.sleep(0.05)
    source = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = pair_stream(source, disorder=50_000).writeStream.format("memory").queryName("late_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert sorted(map(key, as_pairs(spark.table("late_out")).collect())) == batch


def test_terminal_sessions_in_batch_and_stream(spark, tmp_path):
    from sluice.functions import ebcdic
    from sluice.operators import screens as sc
    from sluice.operators import terminal as tm
    from sluice.streaming.terminals import session_stream, user_event_stream

    write = lambda name: bytes([tm.ERASE_WRITE, 0x40, tm.SBA, 0x40, 0x40, tm.SF, 0x20]) + ebcdic.encode(name + ":") + bytes([tm.SF, 0x40]) + ebcdic.encode(" " * 10)
    submit = lambda at, text: bytes([0x7D, 0x40, 0x40, tm.SBA, 0x40, 0x40 | at]) + ebcdic.encode(text)
    rows = [(f"s{k % 3}", k, submit(7, f"U{k}"), 100 * k + 50, write("USER" if k % 2 else "NAME"), 100 * k) for k in range(12)]
    flat = "flow_id string, n long, request binary, request_ts long, response binary, response_ts long"
    df = spark.createDataFrame(rows, flat)
    batch = tm.terminal_events(df.select("flow_id", "n", F.struct(F.col("request").alias("data"), F.col("request_ts").alias("ts_us")).alias("request"), F.struct(F.col("response").alias("data"), F.col("response_ts").alias("ts_us")).alias("response")))
    loaded = sc.load_screens("version: 1\nscreens: [{id: USR, match: [{position: {row: 1, column: 2, length: 5}, equals: 'USER:'}]}]")
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], flat).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        time.sleep(0.05)
    source = spark.readStream.schema(flat).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    events = session_stream(source, idle_ms=6_000)
    q = events.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    end, ended = time.monotonic() + 120, []
    while len(ended) < 3 and time.monotonic() < end:
        time.sleep(1)
        ended = spark.table("sessions_out").where("type = 'SESSION_END'").collect()
    q.stop()
    assert sorted((r.session_key, r.ts_us) for r in ended) == [(f"s{k}", 100 * (9 + k) + 50) for k in range(3)]
    got = spark.table("sessions_out").where("type <> 'SESSION_END'")
    assert sorted(map(str, got.drop("screen").collect())) == sorted(map(str, batch.collect()))
    keep = ("session_key", "n")
    events_of = lambda f: sorted(str((r.session_key, r.n, r.ts, r.operator_id, sorted(r.attributes.items()))) for r in f.collect())
    assert events_of(user_event_stream(got, loaded, keep=keep)) == events_of(sc.terminal_user_events(batch, loaded, keep=keep))


def test_strict_json_without_python(spark):
    import json

    from sluice.functions.binary import strict_variant

    texts = ["{}", "1] x", '{"a":1} x', "[1,2]", '"x"', "null", "1,2", '1,"a":2', '1 "b":3', "{a:1}", "{'a':1}", ' {"a":[1]} ', "tru", "01", '"\t"', "[1,]", "1}", '{"a":1}}', "1]", "[1]]", "-", "1e5", '{"a":1}\x00', "/*c*/1", '"], "a": ["', '{"a":{"b":"}"}}', "1]}", "1],[2", '1},{"a":1', "\ufeff{}", "{", '"\\u12"']
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in [*texts, "", " \n", None]], "t string").select("t", F.to_json(strict_variant(F.col("t"))).alias("v")).collect()}
    assert got.pop("") == got.pop(" \n") == "{}" and got.pop(None) is None
    for t, v in got.items():
        try:
            want = json.loads(t)
        except ValueError:
            assert v is None, t
        else:
            assert v is not None and json.loads(v) == want, t


def test_bodies_of_any_bytes_and_charsets(spark):
    from sluice.operators import http as h

    odd = bytes([0xFF, 0xFE, 0x80, 65])
    rows = [(odd, None), (odd, "text/plain; charset=us-ascii"), (odd, "a; charset=nonsense"), ("日本".encode("shift_jis"), "a; charset=Shift_JIS"), (b"\xe9\x80", "a;charset=windows-1252"), (b"\xe9", "a; charset=latin1"), ("é".encode("utf-16"), "a; charset=utf-16"), (b"\x00", "a; charset=utf-16"), (None, "a"), (b"", "a")]
    got = [r.t for r in spark.createDataFrame(rows, "b binary, c string").select(h.body_text(F.col("b"), F.col("c")).alias("t")).collect()]
    assert got == ["\ufffd\ufffd\ufffdA", "\ufffd\ufffd\ufffdA", "\ufffd\ufffd\ufffdA", "日本", "é€", "é", "é", "\ufffd", None, ""]


def test_rules_need_no_python(spark, tiny):
    from sluice.plans.queries import QUERIES

    for name in ("rule_all_match", "session_resolve", "user_event_assembly"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_transactions_in_batch_and_stream(spark, tmp_path):
    from sluice.operators import reports as rp
    from sluice.streaming.transactions import as_transactions, transaction_stream

    rng = random.Random(32)
    kinds = "tx_id string, ord long, type string, data binary, ts_us long"
    rows = [(f"t{rng.randrange(4)}", k, rng.choice(["REQUEST", "RESPONSE"]), None if k % 9 == 0 else b"%d" % k, k) for k in range(60)]
    key = lambda r: (r.tx_id, r.use, *((s and (s.data and bytes(s.data), s.ts_us)) for s in (r.request, r.response)))
    batch = sorted(map(key, rp.regroup(spark.createDataFrame(rows, kinds)).collect()), key=str)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        time.sleep(0.05)
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = transaction_stream(source, wait_ms=8_000).writeStream.format("memory").queryName("tx_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got, end = [], time.monotonic() + 120
    while len(got) < len(batch) and time.monotonic() < end:
        time.sleep(1)
        got = as_transactions(spark.table("tx_out")).collect()
    q.stop()
    assert sorted(map(key, got), key=str) == batch


def test_metrics_of_a_running_stream(spark, tmp_path):
    from sluice.operators import metrics as mt

    assert mt.merged([{"a": 1, "h": {"n": 0, "total": None, "least": None, "most": None}}, {"a": 2, "h": {"n": 1, "total": 5, "least": 5, "most": 5}}, {"h": {"n": 2, "total": 4, "least": 1, "most": 3}}]) == {"a": 3, "h": {"n": 3, "total": 9, "least": 1, "most": 5}}
    rows = random_segments(60)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], SEGMENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    totals = mt.Totals()
    spark.streams.addListener(totals)
    try:
        q = mt.observed(source, "segments", *mt.segment_metrics()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        end = time.monotonic() + 30
        want = {"live.segment.accepted": sum(not (not r[8] and r[7] & 31 == 16) for r in rows), "capture.segment.skipped.pureAck": sum(not r[8] and r[7] & 31 == 16 for r in rows), "live.byteStream.bytes": {"n": sum(bool(r[8]) for r in rows), "total": sum(len(r[8]) for r in rows), "least": 1, "most": 2}}
        while totals.seen.get("segments") != want and time.monotonic() < end:
            time.sleep(0.5)
        assert totals.seen["segments"] == want
    finally:
        spark.streams.removeListener(totals)


def test_outcomes_of_segments(spark):
    rows = [("f", 0, True, 10, b"ab"), ("f", 1, True, 10, b"ab"), ("f", 2, True, 14, b"ef"), ("f", 3, True, 14, b"e"), ("f", 4, True, 12, b"cde"), ("f", 5, False, 1, b""), ("f", 6, False, None, b"x"), ("f", 7, True, 15, b"fgh")]
    got = reassembly.outcomes(spark.createDataFrame(rows, "flow_id string, arrival long, from_client boolean, seq long, payload binary")).orderBy("arrival").collect()
    names = ("duplicate", "stored", "buffered", "contiguous")
    assert [("".join(n[0] for n in names if r[n]), r.n_bytes) for r in got] == [("sc", 2), ("db", 0), ("sb", 0), ("db", 0), ("sc", 4), ("", 0), ("", 0), ("sc", 2)]


def test_rules_change_while_a_stream_runs(spark, tmp_path):
    from sluice.sources.config import Watched
    from sluice.streaming.events import event_stream

    pair = "struct<data: binary, ts_us: bigint>"
    kinds = f"flow_id string, n bigint, request {pair}, response {pair}, client struct<ip: string, port: int>"
    rules_file = tmp_path / "rules.yaml"
    text = "version: 1\ndefaults: {{app: demo, source: s}}\nrules: [{{id: {}, match: {{method: GET}}}}]"
    rules_file.write_text(text.format("one"))
    watched = Watched([str(rules_file)], rules.load_rule_files, 1.0)
    seen = []

    def write(events, number):
        seen.extend((number, r.flow_id, r.rule_id, r.app) for r in events.collect())
        changed = {0: text.format("two"), 1: "version: 9"}.get(number)
        if changed:
            rules_file.write_text(changed)
            os.utime(rules_file, ns=(1, 10**9 * (number + 2)))
            time.sleep(1.1)

    for k in range(3):
        spark.createDataFrame([(f"f{k}", 1, (b"GET / HTTP/1.1\r\n\r\n", 1), (b"HTTP/1.1 200 OK\r\n\r\n", 2), ("1.1.1.1", 5))], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        time.sleep(0.05)
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    event_stream(source, watched, write, keep=("flow_id",)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(n, r, a) for n, _, r, a in seen] == [(0, "one", "demo"), (1, "two", "demo"), (2, "two", "demo")]


def test_ranges_equal_windows_over_whole_keys(spark):
    from sluice.operators import metrics as mt
    from sluice.operators import ranges as rg

    rows = random_segments(160) + [(200 + k, k, None, None, None, None, k, (1, 2, 0, 18)[k % 4], b"") for k in range(9)] + [(-5, 1, "10.0.0.1", 1000, "10.0.0.10", 80, 1, 0, b"x")]
    df = spark.createDataFrame(rows, SEGMENT).repartition(3)
    key = lambda f: sorted(map(str, f.collect()))
    for width in (1, 7, 1000):
        assert key(rg.orient(df, width)) == key(flows.orient(df).select(*rg.orient(df, width).columns))
    rng = random.Random(8)
    m = spark.createDataFrame([(f"f{f}", k, rng.choice(["REQUEST", "RESPONSE"]), k * 3) for f in range(4) for k in rng.sample(range(200), 60)] + [(None, 1, "RESPONSE", 1), (None, 2, "REQUEST", 2)], "flow_id string, ord long, type string, v int")
    for width in (1, 9, 1000):
        assert key(rg.http_ordinals(m, width=width)) == key(pairing.http_ordinals(m))
        assert key(rg.high_water(m, "flow_id", "ord", "v", width)) == key(mt.high_water(m, "flow_id", "ord", "v"))
        opens, closes = F.col("type") == "REQUEST", F.col("v") % 2 == 0
        assert key(rg.active(m, "flow_id", "ord", opens, closes, width)) == key(mt.active(m, "flow_id", "ord", opens, closes))
    assert rg.orient(df.limit(0)).count() == 0


def test_telnet_ranges_equal_the_machine(spark):
    from sluice.operators import telnet_ranges

    rng = random.Random(51)
    tokens = [b"\xff\xef", b"\xff\xef", b"\xff", b"\xff\xfa", b"\xff\xf0", b"\xff\xf0", b"\xff\xfb", b"\xfd", b"A", b"BC"]  # ends of records, marks, sub-negotiations, options, data
    rows, arrival = [], 0
    for flow in ("a", "b", None):
        for _ in range(120):
            rows.append((flow, arrival, rng.random() < 0.4, b"".join(rng.choice(tokens) for _ in range(rng.randrange(0, 9))) or None, arrival * 3))
            arrival += 1
    df = spark.createDataFrame(rows, "flow_id string, arrival long, from_client boolean, data binary, ts_us long").repartition(3)
    key = lambda f: sorted(map(str, f.collect()))
    want = key(terminal.frame_records(df))
    assert len(want) > 30
    for width in (1, 13, 100_000):
        assert key(telnet_ranges.frame_records(df, width)) == want
    assert telnet_ranges.frame_records(df.limit(0)).count() == 0


def test_protocol_lines_are_of_all_pairs(spark, tiny):
    from sluice.plans import queries

    ids = [r.event_id for r in spark.read.parquet(f"{tiny}/events.parquet").select("event_id").collect()]
    lines = queries.protocol_pair_lines(spark, tiny).collect()
    assert sorted((r.event_id, r.value) for r in lines) == sorted((i, '{"protocol":"%s"}' % ("TN3270" if i % 2 else "HTTP")) for i in ids)
    share = terminal.sampled(spark.range(500), 0.3, F.col("id")).collect()
    assert sorted(r.id for r in share) == [i for i in range(500) if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 1_000_000 < 300_000]


def test_telnet_ranges_stay_whole_where_plans_change_at_run_time(spark):
    """Slices of each range lie in many input partitions, and a join's small side would be found small only as the plan is changed."""
    from sluice.operators import telnet_ranges

    noise = F.concat(*(F.sha2((F.col("id") * 31 + k).cast("string"), 512) for k in range(4)))
    payload = F.concat(noise.cast("binary"), F.lit(bytes([terminal.IAC, terminal.EOR])))
    slices = spark.range(0, 6000, 1, 1).repartition(6).select(F.lit("a").alias("flow_id"), F.col("id").alias("arrival"), F.lit(False).alias("from_client"), payload.alias("data"), F.col("id").alias("ts_us"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    try:
        for n, v in zip(names, ("-1", "50k"), strict=True):
            spark.conf.set(n, v)
        framed = telnet_ranges.frame_records(slices, 700).select("ord", "ts_us", F.octet_length("data").alias("n")).collect()
        assert sorted(map(tuple, framed)) == [(k, k, 512) for k in range(6000)]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_index_lines_that_are_cut(spark, tmp_path):
    """A line that isn't whole gives the fields that can be found, as long as it names its side."""
    lines = ['{"id":"a","kind":"REQ","ts_first":5,"first_line":"x \\"y\\"","headers_blob":null,"body_blob":"b.seg","body_off":7,"body_l', '{"id":"b","kind":', "", "junk", '{"kind": "RSP", "id": "c", "ts_first": 9} trailing', '{"id":"d","kind":"RSP","ts_first":3}']
    (tmp_path / "index-1.ndjson").write_text("\n".join(lines) + "\n")
    got = store.read_index(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.kind, r.ts_first, r.first_line, r.headers_blob, r.body_blob, r.body_off) for r in got] == [("a", "REQUEST", 5, 'x "y"', None, "b.seg", 7), ("c", "RESPONSE", 9, None, None, None, None), ("d", "RESPONSE", 3, None, None, None, None)]
