"""Registered queries of the flow operators over the derived tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import detect, engine, flows, http, metrics, pairing, ranges, reassembly, reports, rules, screens, telnet_ranges, terminal
from ..session import scratch_folder
from ..sources import capture, feeds, store, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Flows lie within conversations, by which their segments are partitioned already.
BY_CONVERSATION = ("conv", "flow_id")

SEGMENTS = """
seg0 AS (SELECT *, event_id % 2 = 0 AS up, event_type = 'click' AND event_id % 7 = 0 AS bare,
         '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS cip, CAST(40000 + user_id AS INT) AS cport,
         '10.1.0.' || CAST(1 + user_id % 3 AS VARCHAR) AS sip, CASE user_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 23 ELSE 9000 END AS sport FROM events),
segments AS (SELECT event_id AS arrival, epoch_us(ts) AS ts_us, CASE WHEN up THEN cip ELSE sip END AS src_ip, CASE WHEN up THEN cport ELSE sport END AS src_port,
         CASE WHEN up THEN sip ELSE cip END AS dst_ip, CASE WHEN up THEN sport ELSE cport END AS dst_port, event_id * 16 AS seq,
         (CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'signup' AND up THEN 2 ELSE 0 END)
         + (CASE WHEN event_type = 'purchase' THEN 8 ELSE 0 END) + (CASE WHEN bare THEN 16 ELSE 0 END) AS flags,
         CASE WHEN bare THEN '' ELSE props END AS payload FROM seg0)"""

ORIENTED = (
    SEGMENTS
    + """,
or1 AS (SELECT *, src_ip || ':' || src_port AS src, CASE WHEN flags & 5 <> 0 THEN 1 ELSE 0 END AS closes,
        CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port END AS conv FROM segments),
or2 AS (SELECT *, CAST(coalesce(sum(closes) OVER (PARTITION BY conv ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS incarnation FROM or1),
or3 AS (SELECT *, coalesce(last_value(CASE WHEN flags & 2 <> 0 AND flags & 16 = 0 THEN src END IGNORE NULLS) OVER w, first_value(src) OVER w) AS client FROM or2
        WINDOW w AS (PARTITION BY conv, incarnation ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
oriented AS (SELECT *, src = client AS from_client, CAST(coalesce(sum(closes) OVER (PARTITION BY conv, client ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS flow_seq FROM or3),
flow AS (SELECT *, conv || '#' || client || '#' || flow_seq AS flow_id, CASE WHEN from_client THEN dst_port ELSE src_port END AS server_port FROM oriented)"""
)

MESSAGES = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS flow_id, turn AS ord, CASE WHEN role = 'user' THEN 'REQUEST' ELSE 'RESPONSE' END AS type, coalesce(text, '') AS text, turn * 1000 + length(coalesce(text, '')) AS ts_us
         FROM conversations)"""

FLOW_MESSAGES = ORIENTED + """,
messages AS (SELECT flow_id, arrival AS ord, CASE WHEN from_client THEN 'REQUEST' ELSE 'RESPONSE' END AS type, ts_us FROM flow WHERE payload <> '')"""

LINDLEY = """,
li1 AS (SELECT *, sum(CASE WHEN type = 'REQUEST' THEN 1 ELSE -1 END) OVER w AS s FROM messages WINDOW w AS (PARTITION BY flow_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
li2 AS (SELECT *, greatest(0, -min(s) OVER w) AS u FROM li1 WINDOW w AS (PARTITION BY flow_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
li3 AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY flow_id ORDER BY ord), 0) AS b, count(*) FILTER (type = 'REQUEST') OVER w AS q, count(*) FILTER (type = 'RESPONSE') OVER w AS p FROM li2
        WINDOW w AS (PARTITION BY flow_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
numbered AS (SELECT *, CAST(CASE WHEN type = 'REQUEST' THEN q WHEN u = b THEN p - u END AS BIGINT) AS n FROM li3)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.orient(tables.segments(spark, sf_dir))


def _flow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("from_client"), "REQUEST").otherwise("RESPONSE")
    return flows.with_payload(_oriented(spark, sf_dir)).select("conv", "flow_id", F.col("arrival").alias("ord"), kind.alias("type"), F.col("payload").alias("data"), "ts_us")


@query(f"WITH {ORIENTED} SELECT arrival, conv, client, from_client, flow_seq FROM oriented")
def flow_orientation(spark, sf_dir):
    return _oriented(spark, sf_dir).select("arrival", "conv", "client", "from_client", "flow_seq")


#: All segments as those of one conversation.
HOT = ORIENTED.replace("CAST(user_id % 250 AS VARCHAR) AS cip, CAST(40000 + user_id AS INT) AS cport", "'1' AS cip, 40000 AS cport").replace("CAST(1 + user_id % 3 AS VARCHAR) AS sip, CASE user_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 23 ELSE 9000 END AS sport", "'1' AS sip, 80 AS sport")
RANGE = 1000


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.expr("arrival % 2 = 0")
    end = lambda client, server: F.when(up, F.lit(client)).otherwise(F.lit(server))
    ends = {"src_ip": end("10.0.0.1", "10.1.0.1"), "src_port": end(40000, 80), "dst_ip": end("10.1.0.1", "10.0.0.1"), "dst_port": end(80, 40000)}
    return ranges.orient(tables.segments(spark, sf_dir).withColumns(ends), RANGE)


@query(f"WITH {HOT} SELECT arrival, conv, incarnation, client, from_client, flow_seq FROM oriented")
def hot_conversation(spark, sf_dir):
    """One conversation of all segments, oriented by ranges of arrivals."""
    return _hot(spark, sf_dir).select("arrival", "conv", "incarnation", "client", "from_client", "flow_seq")


@query(f"WITH {HOT}, messages AS (SELECT conv AS flow_id, arrival AS ord, CASE WHEN from_client THEN 'REQUEST' ELSE 'RESPONSE' END AS type FROM oriented WHERE payload <> ''){LINDLEY} SELECT ord, type, n FROM numbered")
def hot_conversation_pairs(spark, sf_dir):
    """The transaction of each message of one long flow, by ranges."""
    kind = F.when(F.col("from_client"), "REQUEST").otherwise("RESPONSE")
    m = flows.with_payload(_hot(spark, sf_dir)).select(F.col("conv").alias("flow_id"), F.col("arrival").alias("ord"), kind.alias("type"))
    return ranges.http_ordinals(m, width=RANGE).select("ord", "type", "n")


@query(f"WITH {ORIENTED} SELECT conv, incarnation, count(*) AS n_segments, CAST(sum(length(payload)) AS BIGINT) AS n_bytes, min(arrival) AS first_arrival FROM oriented GROUP BY conv, incarnation")
def flow_incarnations(spark, sf_dir):
    return _oriented(spark, sf_dir).groupBy("conv", "incarnation").agg(F.count("*").alias("n_segments"), F.sum(F.octet_length("payload")).alias("n_bytes"), F.min("arrival").alias("first_arrival"))


@query(f"WITH {SEGMENTS} SELECT arrival, flags FROM segments WHERE NOT (payload = '' AND flags & 31 = 16)")
def pure_ack_filter(spark, sf_dir):
    return flows.drop_pure_acks(tables.segments(spark, sf_dir)).select("arrival", "flags")


@query(f"WITH {SEGMENTS} SELECT arrival, flags & 1 <> 0 AS fin, flags & 2 <> 0 AS syn, flags & 4 <> 0 AS rst, flags & 8 <> 0 AS psh, flags & 16 <> 0 AS ack, flags AS packed FROM segments")
def flag_unpack(spark, sf_dir):
    s = flows.unpack_flags(tables.segments(spark, sf_dir))
    names = ["fin", "syn", "rst", "psh", "ack"]
    return s.select("arrival", *names, flows.pack_flags(**{n: F.col(n) for n in names}).alias("packed"))


@query(f"WITH {SEGMENTS} SELECT arrival, octet_length(encode(payload)) AS size FROM segments WHERE payload <> ''")
def payload_filter(spark, sf_dir):
    return flows.with_payload(tables.segments(spark, sf_dir)).select("arrival", F.octet_length("payload").cast("long").alias("size"))


@query(f"WITH {SEGMENTS} SELECT arrival FROM segments WHERE (src_port = 23 OR dst_port = 23) OR src_ip = '10.0.0.8'")
def bpf_filter(spark, sf_dir):
    return tables.segments(spark, sf_dir).where(capture.bpf("tcp and (port 23 or src host 10.0.0.8)")).select("arrival")


@query(f"WITH {ORIENTED} SELECT arrival, CASE WHEN server_port IN (80, 8080, 8000, 3128) THEN 'HTTP' WHEN server_port IN (23, 992) THEN 'TN3270' ELSE 'UNKNOWN' END AS protocol FROM flow")
def protocol_classify(spark, sf_dir):
    s = _oriented(spark, sf_dir)
    return s.select("arrival", detect.classify(flows.server_port(s), F.col("payload")).alias("protocol"))


_BEGIN = ["GET ", "HTTP/1.1 ", "POST", "delete ", "PATCH ", "\\xff", "OPTIONS /"]


@query(
    "WITH p AS (SELECT page_id, CASE page_id % 7 "
    + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_BEGIN))
    + " END || url AS t FROM pages) SELECT page_id, regexp_matches(t, '^(?:(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|TRACE|PATCH) |HTTP/)') AS by_head, page_id % 11 = 0 AS by_mark FROM p"
)
def http_signature(spark, sf_dir):
    begin = F.element_at(F.array(*map(F.lit, _BEGIN)), (F.col("page_id") % 7 + 1).cast("int"))
    marked = F.concat(F.col("url").cast("binary"), F.when(F.col("page_id") % 11 == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    return tables.read(spark, sf_dir, "pages").select("page_id", detect.has_http_signature(F.concat(begin, "url").cast("binary")).alias("by_head"), detect.has_telnet_signature(marked).alias("by_mark"))


@query(f"WITH {ORIENTED}, o AS (SELECT flow_id, arrival, payload, coalesce(sum(length(payload)) OVER (PARTITION BY flow_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM flow WHERE payload <> '') SELECT flow_id, string_agg(substr(payload, 1, CAST(512 - before AS INT)), '' ORDER BY arrival) AS preface FROM o WHERE before < 512 GROUP BY flow_id")
def flow_preface(spark, sf_dir):
    return detect.preface(_oriented(spark, sf_dir)).select("flow_id", F.col("preface").cast("string").alias("preface"))


@query(f"WITH {FLOW_MESSAGES}{LINDLEY} SELECT q.flow_id, q.n, q.ord AS request_ord, p.ord AS response_ord FROM numbered q JOIN numbered p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'")
def http_fifo_pairs(spark, sf_dir):
    return pairing.http_pairs(_flow_messages(spark, sf_dir), keys=BY_CONVERSATION).select("flow_id", "n", F.col("request.ord").alias("request_ord"), F.col("response.ord").alias("response_ord"))


@query(f"WITH {FLOW_MESSAGES}{LINDLEY} SELECT q.flow_id, q.n, q.ord AS request_ord, coalesce(p.ord, -1) AS response_ord FROM numbered q LEFT JOIN numbered p ON q.flow_id = p.flow_id AND q.n = p.n AND p.type = 'RESPONSE' WHERE q.type = 'REQUEST'")
def http_flush_pairs(spark, sf_dir):
    return pairing.http_pairs(_flow_messages(spark, sf_dir), True, BY_CONVERSATION).select("flow_id", "n", F.col("request.ord").alias("request_ord"), F.coalesce("response.ord", F.lit(-1).cast("long")).alias("response_ord"))


@query(f"WITH {FLOW_MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id, type ORDER BY ord) AS n FROM messages) SELECT q.flow_id, q.n, q.ord AS request_ord, p.ord AS response_ord FROM k q JOIN k p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'")
def tn_fifo_pairs(spark, sf_dir):
    return pairing.two_way_pairs(_flow_messages(spark, sf_dir), BY_CONVERSATION).select("flow_id", F.col("n").cast("long").alias("n"), F.col("request.ord").alias("request_ord"), F.col("response.ord").alias("response_ord"))


@query(f"WITH {MESSAGES}{LINDLEY} SELECT q.flow_id, q.n, greatest(0, p.ts_us - q.ts_us) AS latency_us FROM numbered q JOIN numbered p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'")
def pair_latency(spark, sf_dir):
    return pairing.latency(pairing.http_pairs(tables.messages(spark, sf_dir))).select("flow_id", "n", "latency_us")


@query(f"WITH {FLOW_MESSAGES}{LINDLEY} SELECT flow_id, ord, substr(sha256(flow_id || '|' || coalesce('t' || n, 'o' || ord)), 1, 26) AS tx_id FROM numbered")
def tx_id_propagation(spark, sf_dir):
    return pairing.with_tx_id(_flow_messages(spark, sf_dir), keys=BY_CONVERSATION).select("flow_id", "ord", "tx_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS flow_id, sha256(text) AS digest, strlen(text) AS n_bytes FROM documents")
def reassemble_bytes(spark, sf_dir):
    return reassembly.assembled(tables.chunks(spark, sf_dir), ["flow_id"]).select("flow_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("n_bytes"))


@query(
    """WITH c AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size, unnest(range(0, (strlen(text) - 1) // 400 + 1)) AS k FROM documents WHERE text IS NOT NULL),
    a AS (SELECT *, max(CASE WHEN k = 0 THEN 0 ELSE 1 + k * 7919 % 1009 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS whole FROM c),
    e AS (SELECT doc_id, whole AS arrival, any_value(h) AS h, least(any_value(size), 400 * max(k) + 425) AS stop, CASE WHEN max(k) > 0 AND any_value(size) - 400 * max(k) <= 25 THEN max(k) - 1 ELSE max(k) END AS last
          FROM a GROUP BY doc_id, whole, size),
    s AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY arrival), 0) AS start FROM e)
    SELECT CAST(doc_id AS VARCHAR) AS flow_id, CAST(arrival AS BIGINT) AS arrival, CAST(CASE WHEN last = 0 THEN 0 ELSE 1 + last * 7919 % 1009 END AS BIGINT) AS ts_us, CAST(stop - start AS BIGINT) AS n_bytes, sha256(substr(h, 2 * start + 1, 2 * (stop - start))) AS digest FROM s WHERE stop > start"""
)
def reassemble_slices(spark, sf_dir):
    """What each piece releases as it arrives: the bytes that have become contiguous with it, and the time of the last piece that holds them."""
    c = tables.chunks(spark, sf_dir).select("flow_id", "arrival", F.lit(True).alias("from_client"), "seq", "payload", F.col("arrival").alias("ts_us"))
    return reassembly.slices(c).select("flow_id", "arrival", "ts_us", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2(F.hex("data").cast("binary"), 256).alias("digest"))


@query(f"WITH {SEGMENTS} SELECT arrival, CAST(instr(payload, '\"k\": 7') - 1 AS BIGINT) AS at, substr(payload, greatest(1, instr(payload, '\"k\": 7') - 4), instr(payload, '\"k\": 7') - greatest(1, instr(payload, '\"k\": 7') - 4) + 10) AS around FROM segments WHERE contains(payload, '\"k\": 7')")
def payload_grep(spark, sf_dir):
    return metrics.grep(tables.segments(spark, sf_dir), b'"k": 7', context=4).select("arrival", "at", "around")


@query("SELECT page_id, split_part(split_part(url, '://', 2), '?', 1) AS path, CAST(page_id % 7 AS VARCHAR) AS page, 'a b' AS q FROM pages")
def query_param_parse(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.split("url", "://"), 2), F.lit("?Q=x&q=a%20b&page="), (F.col("page_id") % 7).cast("string"), F.lit("&=z&bad=%zz")).alias("target"))
    q = http.query_map(F.substring_index("target", "?", -1))
    return p.select("page_id", F.substring_index("target", "?", 1).alias("path"), q["page"].alias("page"), q["q"].alias("q"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS uid, event_type AS last FROM events")
def cookie_parse(spark, sf_dir):
    c = http.cookie_map(F.concat(F.lit("Last=first; UID="), F.col("user_id").cast("string"), F.lit("; bare; last="), F.col("event_type")))
    return tables.read(spark, sf_dir, "events").select("event_id", c["uid"].alias("uid"), c["last"].alias("last"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) = 7 AS is_seven FROM events WHERE props->>'$.k' IS NOT NULL")
def json_predicates(spark, sf_dir):
    j = F.try_variant_get(binary.strict_variant(F.col("props")), rules.json_path("$.k"), "string")
    return tables.read(spark, sf_dir, "events").select("event_id", j.cast("long").alias("k"), (j == "7").alias("is_seven")).where("k IS NOT NULL")


RULES = """
version: 1
defaults: {app: demo, source: gateway}
rules:
  - id: buy
    description: Somebody buys
    match:
      method: [POST]
      path: {regex: '^/u/(?P<user>[0-9]+)/purchase$'}
      status: {in: [200, 201]}
    extract:
      user_id: path.user
      extra: {key: query.k, agent: header.User-Agent}
    event: {type: user.buy, attributes: {channel: web}}
  - id: low
    match:
      body:
        jsonpath: [{path: $.k, regex: '^[0-4]$'}]
    event: {type: body.low}
"""


def _event_exchanges(spark, sf_dir) -> DataFrame:
    """Each event as an exchange of its user's client."""
    request, response = tables.event_messages()
    side = lambda text, ts: F.struct(text.cast("binary").alias("data"), ts.alias("ts_us"))
    client = F.struct(F.concat(F.lit("10.0.0."), F.expr("CAST(user_id % 250 AS STRING)")).alias("ip"), F.expr("CAST(40000 + user_id AS INT)").alias("port"))
    e = tables.read(spark, sf_dir, "events")
    return http.exchanges(e.select(F.col("event_id").cast("string").alias("flow_id"), F.lit(1).cast("long").alias("n"), side(request, tables.micros()).alias("request"), side(response, tables.micros() + 1500).alias("response"), client.alias("client")))


HTTP_EVENTS = """ev AS (SELECT *, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS cip, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS closes, epoch_us(ts) AS us,
        CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END || ' /u/' || user_id || '/' || event_type || '?K=' || event_id % 9 || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: a' || chr(13) || chr(10) || 'User-Agent: agent' || event_id % 3
          || chr(13) || chr(10) || 'Cookie: ' || CASE WHEN event_id % 4 = 0 THEN 'JSESSIONID=s' || user_id ELSE 'x=1' END || chr(13) || chr(10) || chr(13) || chr(10) AS q,
        'HTTP/1.1 ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' X' || chr(13) || chr(10) || 'Content-Type: application/json' || chr(13) || chr(10) || chr(13) || chr(10) || props AS p FROM events),
ev2 AS (SELECT *, CAST(coalesce(sum(closes) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS inc FROM ev),
http_pairs AS (SELECT *, cip || ':' || (40000 + user_id) || '|10.1.0.1:80#' || cip || ':' || (40000 + user_id) || '#' || inc AS flow_id, row_number() OVER (PARTITION BY user_id, inc ORDER BY event_id) AS n FROM ev2)"""


@query(f"WITH {HTTP_EVENTS} SELECT flow_id, n, 'HTTP' AS protocol, q AS request, CASE WHEN n = 1 THEN us + 750 ELSE us END AS request_ts, p AS response, us + 1500 AS response_ts, cip AS client_ip, 80 AS server_port FROM http_pairs")
def segments_to_pairs(spark, sf_dir):
    """Raw segments, out of order and of many incarnations, to pairs in one pass."""
    p = detect.of_protocol(engine.segments_to_pairs(tables.http_segments(spark, sf_dir)).where("n IS NOT NULL"), "HTTP")
    return p.select("flow_id", "n", "protocol", F.col("request.data").cast("string").alias("request"), F.col("request.ts_us").alias("request_ts"), F.col("response.data").cast("string").alias("response"), F.col("response.ts_us").alias("response_ts"), F.col("client.ip").alias("client_ip"), F.col("server.port").alias("server_port"))


@query(
    f"""WITH {HTTP_EVENTS} SELECT flow_id, n, 'buy' AS rule_id, CAST(user_id AS VARCHAR) AS user_id, make_timestamp(us + 1500) AS ts,
    CASE WHEN event_id % 4 = 0 THEN 's' || user_id ELSE 'DERIVED-' || upper(substr(sha256(cip || '|agent' || event_id % 3 || '|' || CAST(floor((CASE WHEN n = 1 THEN us + 750 ELSE us END) / 900000000) AS BIGINT)), 1, 24)) END AS session_id FROM http_pairs WHERE event_type = 'purchase'"""
)
def segments_to_events(spark, sf_dir):
    """Raw segments to user events: pairs, exchanges, rules, sessions."""
    p = detect.of_protocol(engine.segments_to_pairs(tables.http_segments(spark, sf_dir)).where("n IS NOT NULL"), "HTTP")
    m = rules.evaluate(http.exchanges(p), rules.load_rules(RULES)).where("rule_id = 'buy'")
    return rules.user_events(m, keep=("flow_id", "n")).select("flow_id", "n", "rule_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "session_id")


@query("""SELECT CAST(event_id AS VARCHAR) AS flow_id, 'buy' AS rule_id, CAST(user_id AS VARCHAR) AS user_id, 'agent' || event_id % 3 AS agent, 'web' AS channel FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'low', NULL, NULL, NULL FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 0 AND 4""")
def rule_all_match(spark, sf_dir):
    m = rules.evaluate(_event_exchanges(spark, sf_dir), rules.load_rules(RULES))
    return m.select("flow_id", "rule_id", "user_id", F.try_element_at("attributes", F.lit("agent")).alias("agent"), F.try_element_at("attributes", F.lit("channel")).alias("channel"))


@query("""SELECT CASE WHEN event_id % 4 = 0 THEN 's' || user_id ELSE 'DERIVED-' || upper(substr(sha256('10.0.0.' || user_id % 250 || '|agent' || event_id % 3 || '|' || CAST(floor(epoch_us(ts) / 900000000) AS BIGINT)), 1, 24)) END AS session_id,
    'AUTHENTICATED' AS auth_state, 'user.buy' AS event_type, CAST(1 AS BIGINT) AS latency_ms, 'demo' AS app, event_id AS id FROM events WHERE event_type = 'purchase'""")
def session_resolve(spark, sf_dir):
    m = rules.evaluate(_event_exchanges(spark, sf_dir), rules.load_rules(RULES)).where("rule_id = 'buy'")
    sid, state = rules.session(client_ip=F.col("client.ip"), user_id=F.col("user_id"))
    return m.select(sid.alias("session_id"), state.alias("auth_state"), "event_type", F.floor(F.col("latency_us") / 1000).alias("latency_ms"), F.try_element_at("attributes", F.lit("app")).alias("app"), F.col("flow_id").cast("long").alias("id"))


@query("SELECT ts + INTERVAL 1500 MICROSECOND AS ts, 'buy' AS rule_id, 'demo' AS app, 'gateway' AS source, CAST(user_id AS VARCHAR) AS user_id, 'POST' AS method, 200 AS status FROM events WHERE event_type = 'purchase'")
def user_event_assembly(spark, sf_dir):
    m = rules.evaluate(_event_exchanges(spark, sf_dir), rules.load_rules(RULES)).where("rule_id = 'buy'")
    return rules.user_events(m).select("ts", "rule_id", "app", "source", "user_id", "http.method", "http.status")


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) AS bucket FROM events")
def session_bucket(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", F.floor(tables.micros() / rules.SESSION_BUCKET_US).alias("bucket"))


@query("SELECT CAST(event_id AS VARCHAR) AS flow_id, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/u/' || user_id || '/' || event_type AS path, CAST(event_id % 9 AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, props AS body FROM events")
def http_exchange_parse(spark, sf_dir):
    x = _event_exchanges(spark, sf_dir)
    return x.select("flow_id", "http_request.method", "http_request.path", F.col("http_request.query")["k"].alias("k"), "http_response.status", F.col("http_response.body").cast("string").alias("body"))


@query()
def http_framing(spark, sf_dir):
    """Events' requests with a body, sent in two slices each, framed again."""
    e = tables.read(spark, sf_dir, "events")
    whole = F.concat(F.lit("POST /x HTTP/1.1\r\nContent-Length: "), F.length("props").cast("string"), F.lit("\r\n\r\n"), F.col("props")).cast("binary")
    s = e.select((F.col("user_id") % 50).cast("string").alias("flow_id"), "event_id", whole.alias("w"), tables.micros().alias("ts_us"))
    halves = s.select("flow_id", F.explode(F.array(F.struct((F.col("event_id") * 2).alias("arrival"), F.expr("substring(w, 1, 20)").alias("data")), F.struct((F.col("event_id") * 2 + 1).alias("arrival"), F.expr("substring(w, 21)").alias("data")))).alias("p"), "ts_us")
    return http.frame(halves.select("flow_id", "p.arrival", F.lit(True).alias("from_client"), "p.data", "ts_us")).select("flow_id", "ord", "type", F.col("data").cast("string").alias("data"), "ts_us")


ORACLE["http_framing"] = "SELECT CAST(user_id % 50 AS VARCHAR) AS flow_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS ord, 'REQUEST' AS type, 'POST /x HTTP/1.1' || chr(13) || chr(10) || 'Content-Length: ' || length(props) || chr(13) || chr(10) || chr(13) || chr(10) || props AS data, epoch_us(ts) AS ts_us FROM events"


SCREENS = """
version: 1
screens:
  - id: THE
    match: [{position: {row: 1, column: 1, length: 3}, equals: "the", ignoreCase: true}]
    label: {position: {row: 1, column: 1, length: 10}, trim: true}
  - id: T
    match: [{position: {row: 1, column: 1, length: 1}, equals: "T"}]
"""


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)
    SELECT doc_id, CASE WHEN lower(substr(rpad(l, 3, ' '), 1, 3)) = 'the' THEN 'THE' WHEN substr(rpad(l, 1, ' '), 1, 1) = 'T' THEN 'T' END AS screen_id,
    CASE WHEN lower(substr(rpad(l, 3, ' '), 1, 3)) = 'the' THEN nullif(trim(substr(rpad(l, 10, ' '), 1, 10)), '') END AS label FROM d""")
def screen_first_match(spark, sf_dir):
    d = screens.first_match(tables.read(spark, sf_dir, "documents"), screens.load_screens(SCREENS), "text")
    return d.select("doc_id", F.col("screen.id").alias("screen_id"), "screen.label")


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'SCREEN_RENDER' WHEN 'click' THEN 'USER_SUBMIT' WHEN 'signup' THEN 'SESSION_START' ELSE 'OTHER' END AS type, props FROM events),
    p AS (SELECT *, count(*) FILTER (type = 'SESSION_START') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM e),
    s AS (SELECT *, last_value(CASE WHEN type = 'SCREEN_RENDER' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS screen FROM p)
    SELECT event_id, screen FROM s WHERE type = 'USER_SUBMIT' AND screen IS NOT NULL""")
def last_screen_asof(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'SCREEN_RENDER' WHEN 'click' THEN 'USER_SUBMIT' WHEN 'signup' THEN 'SESSION_START' ELSE 'OTHER' END")
    e = tables.read(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("type"), "props")
    return terminal.last_screen(e, "user_id", "event_id", "type", ("props",)).select("event_id", F.col("screen.props").alias("screen"))


@query(
    f"""WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id, type ORDER BY ord) AS n FROM messages),
    p AS (SELECT q.flow_id, q.n, q.ts_us AS q_ts, r.ts_us AS r_ts FROM k q JOIN k r ON q.flow_id = r.flow_id AND q.n = r.n AND q.type = 'REQUEST' AND r.type = 'RESPONSE')
    SELECT flow_id AS session_key, CAST(0 AS BIGINT) AS n, 'SESSION_START' AS type, r_ts AS ts_us, NULL AS aid, NULL AS inputs, NULL AS plain, NULL AS field_values, NULL AS screen_name FROM p WHERE n = 1
    UNION ALL SELECT flow_id, 2 * n - 1, 'SCREEN_RENDER', r_ts, NULL, NULL, chr(128) || 'USER:', 'true USER:,false ', 'USER' FROM p
    UNION ALL SELECT flow_id, 2 * n, 'USER_SUBMIT', q_ts, 'ENTER', '{{"USER:":"SMITH"}}', NULL, NULL, 'USER' FROM p
    UNION ALL SELECT flow_id, 2 * max(n) + 1, 'SESSION_END', 99, NULL, NULL, NULL, NULL, 'USER' FROM p GROUP BY flow_id"""
)
def terminal_sessions(spark, sf_dir):
    """Screens that conversations' answers write and requests answer, as terminal events."""
    e = terminal.terminal_events(_screens(spark, sf_dir), 99)
    values = F.array_join(F.transform("fields", lambda f: F.concat_ws(" ", f["protected"].cast("string"), f["value"])), ",")
    return e.select("session_key", "n", "type", "ts_us", "aid", F.to_json("inputs").alias("inputs"), F.rtrim(F.regexp_replace("plain_text", "\\n+$", "")).alias("plain"), values.alias("field_values"), "screen_name")


def _screens(spark, sf_dir) -> DataFrame:
    """Pairs of a screen with one field and what is typed into it, for each answer and request."""
    from ..functions import ebcdic

    write = F.concat(F.lit(bytes([terminal.ERASE_WRITE, 0x40, terminal.SBA, 0x40, 0x40, terminal.SF, 0x20]) + ebcdic.encode("USER:") + bytes([terminal.SF, 0x40])), F.lit(ebcdic.encode("          ")))
    submit = F.concat(F.lit(bytes([0x7D, 0x40, 0x40, terminal.SBA, 0x40, 0x47])), F.lit(ebcdic.encode("SMITH") + b"\0\0" + bytes([terminal.EUA, 0x40, 0x50])))
    m = tables.messages(spark, sf_dir).select("flow_id", "ord", "type", F.when(F.col("type") == "REQUEST", submit).otherwise(write).alias("data"), "ts_us")
    return pairing.two_way_pairs(m)


@query("SELECT event_id, regexp_replace(left(props, length(props) - 3), '\\S', '*', 'g') || right(props, 3) AS password, event_type AS other FROM events")
def redact_inputs(spark, sf_dir):
    m = terminal.redact(F.create_map(F.lit("password"), F.col("props"), F.lit("other"), F.col("event_type")), "pass.*")
    return tables.read(spark, sf_dir, "events").select("event_id", m["password"].alias("password"), m["other"].alias("other"))


@query(f"WITH {MESSAGES}{LINDLEY}, t AS (SELECT *, coalesce('t' || n, 'o' || ord) AS k FROM numbered) SELECT flow_id || '/' || k AS tx_id, coalesce(max(ord) FILTER (type = 'REQUEST'), -1) AS request_ord, coalesce(max(ord) FILTER (type = 'RESPONSE'), -1) AS response_ord FROM t GROUP BY flow_id, k")
def full_outer_regroup(spark, sf_dir):
    n = pairing.http_ordinals(tables.messages(spark, sf_dir))
    key = F.concat_ws("/", "flow_id", F.coalesce(F.concat(F.lit("t"), F.col("n").cast("string")), F.concat(F.lit("o"), F.col("ord").cast("string"))))
    return reports.regroup(n.select(key.alias("tx_id"), "ord", "type", "ts_us")).select("tx_id", *(F.coalesce(f"{s}.ord", F.lit(-1).cast("long")).alias(f"{s}_ord") for s in ("request", "response")))


@query(
    """WITH RECURSIVE m AS (SELECT 'c' || conv_id % 5 AS tx_id, conv_id * 100 + turn AS ord, CASE WHEN role = 'user' THEN 'Q' ELSE 'P' END AS kind FROM conversations),
    i AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY ord) AS i FROM m),
    -- a transaction's sides so far, before the row that may end it
    r(tx_id, i, use, q, p) AS (SELECT DISTINCT tx_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM m
        UNION ALL SELECT i.tx_id, i.i, CASE WHEN q >= 0 AND p >= 0 THEN use + 1 ELSE use END, CASE WHEN kind = 'Q' THEN ord WHEN q >= 0 AND p >= 0 THEN -1 ELSE q END, CASE WHEN kind = 'P' THEN ord WHEN q >= 0 AND p >= 0 THEN -1 ELSE p END
        FROM r JOIN i ON i.tx_id = r.tx_id AND i.i = r.i + 1)
    SELECT tx_id, use, max(q) AS request_ord, max(p) AS response_ord FROM r WHERE i > 0 GROUP BY tx_id, use"""
)
def regroup_reused_ids(spark, sf_dir):
    """Five ids that all conversations use in turn: a transaction ends as soon as it has both sides."""
    c = tables.read(spark, sf_dir, "conversations")
    m = c.select(F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("tx_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.when(F.col("role") == "user", "REQUEST").otherwise("RESPONSE").alias("type"))
    return reports.regroup(m).select("tx_id", "use", *(F.coalesce(f"{s}.ord", F.lit(-1).cast("long")).alias(f"{s}_ord") for s in ("request", "response")))


@query(
    """SELECT event_id, 'v' || user_id AS tok, event_type AS a, CASE WHEN own = 1 THEN 's' || user_id END AS jsessionid, 'HTTP' AS b, CASE event_id % 3 WHEN 0 THEN 's' || user_id WHEN 1 THEN 'late' || event_id ELSE 'DERIVED' END AS session FROM
    (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 END AS own FROM events)"""
)
def header_white_space(spark, sf_dir):
    """Headers with tabs around names and values, two Cookie lines, and two Set-Cookie lines of one name of which the first is blank."""
    text = lambda c: F.col(c).cast("string")
    cookie = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\tJSESSIONID=\ts"), text("user_id"), F.lit("\t;"))).otherwise("none")
    request = F.concat(F.lit("GET /a HTTP/1.1\r\nX-Tok\t:\tv"), text("user_id"), F.lit("\t\r\nCookie: a=first; B=HTTP\r\nCookie:"), cookie, F.lit("\r\nCookie: A="), F.col("event_type"), F.lit("\r\n\r\n"))
    later = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("\tlate"), text("event_id"))).otherwise("")
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nSet-Cookie: JSESSIONID= ; Path=/\r\nSet-Cookie: jsessionid="), later, F.lit("; Secure\r\n\r\n"))
    side = lambda t: F.struct(t.cast("binary").alias("data"), tables.micros().alias("ts_us"))
    client = F.struct(F.lit("10.0.0.1").alias("ip"), F.lit(1).alias("port"))
    x = http.exchanges(tables.read(spark, sf_dir, "events").select(text("event_id").alias("flow_id"), F.lit(1).cast("long").alias("n"), side(request).alias("request"), side(response).alias("response"), client.alias("client")))
    cookies = F.col("http_request.cookies")
    sid = rules.session()[0]
    return x.select(F.col("flow_id").cast("long").alias("event_id"), http.first_value(F.col("http_request.headers"), "x-tok").alias("tok"), cookies["a"].alias("a"), F.try_element_at(cookies, F.lit("jsessionid")).alias("jsessionid"), cookies["b"].alias("b"), F.when(sid.startswith("DERIVED"), "DERIVED").otherwise(sid).alias("session"))


@query()
def http_report_text(spark, sf_dir):
    x = _event_pairs(spark, sf_dir)
    return reports.http_reports(x, "all")


def _event_pairs(spark, sf_dir) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    return _reported(e.select(F.concat(F.lit("txn:"), F.col("event_id").cast("string")).alias("tx_id"), tables.micros().alias("ts_us"), "props"))


def _reported(rows: DataFrame) -> DataFrame:
    """Pairs of ``tx_id, ts_us, props``: a plain request, and ``props`` as the chunked answer."""
    side = lambda text, src, dst: F.struct(text.cast("binary").alias("data"), F.col("ts_us"), F.lit(src).alias("src"), F.lit(dst).alias("dst"))
    chunked = F.concat(F.lit("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX:  y \r\n\r\n"), F.lower(F.hex(F.length("props"))), F.lit("\r\n"), F.col("props"), F.lit("\r\n0\r\n\r\n"))
    return rows.select("tx_id", side(F.lit("GET /a HTTP/1.1\r\nHost: h\r\n\r\n"), "10.0.0.1:9", "10.1.0.1:80").alias("request"), side(chunked, "10.1.0.1:80", "10.0.0.1:9").alias("response"))


def _section_sql(title: str, src: str, dst: str, *lines: str) -> str:
    head = [f"'=== {title} ==='", *(["'# id: ' || id"] if "HTTP" in title else []), "'# timestamp_us: ' || us", f"'# src: {src}'", f"'# dst: {dst}'", "''", *lines]
    return " || ".join(f"{x} || chr(10)" for x in head)


_ENDS = ("10.0.0.1:9", "10.1.0.1:80")
_DUMP = """CASE WHEN length({0}) = 0 THEN '' ELSE list_aggregate(list_transform(range(0, (length({0}) - 1) // {1} + 1), lambda k: printf('%04x', k * {1}) || ': ' || rpad(list_aggregate(list_transform(range(k * {1} + 1, least(length({0}), (k + 1) * {1}) + 1), lambda i: lower(hex(encode(substr({0}, i, 1)))) || ' '), 'string_agg', ''), 3 * {1}, ' ')
    || ' |' || substr({0}, k * {1} + 1, {1}) || '|' || chr(10)), 'string_agg', '') END"""
_HTTP_REPORT = f"""{_section_sql("HTTP REQUEST", *_ENDS, "'GET /a HTTP/1.1'", "'Host: h'", "''", "'(empty body)'")} || chr(10)
    || {_section_sql("HTTP RESPONSE", *_ENDS[::-1], "'HTTP/1.1 200 OK'", "'X: y'", "'Content-Length: ' || length(props)", "''", "props")} AS content, us || '_' || replace(id, ':', '_') || '.http' AS file_name"""
ORACLE["http_report_text"] = f"WITH e AS (SELECT *, 'txn:' || event_id AS id, epoch_us(ts) AS us FROM events) SELECT 'HTTP' AS protocol, id AS tx_id, us AS ts_us, {_HTTP_REPORT} FROM e"


@query(
    f"""WITH e AS (SELECT *, 'txn:' || event_id AS id, epoch_us(ts) AS us FROM events)
    SELECT id AS tx_id, us || '_txn_' || event_id || '.tn3270.txt' AS file_name, {_section_sql("TN3270 REQUEST", *_ENDS).removesuffix(" || chr(10)")} || chr(10) || {_DUMP.format("props", 16)} || chr(10) || '=== TN3270 RESPONSE ===' || chr(10)
    || CASE WHEN event_id % 2 = 0 THEN '(no response captured)' || chr(10) ELSE {_section_sql("TN3270 RESPONSE", *_ENDS[::-1], "'(empty payload)'").split(" || chr(10) || ", 1)[1]} END AS content FROM e"""
)
def terminal_report_text(spark, sf_dir):
    return reports.terminal_reports(_terminal_pairs(spark, sf_dir)).select("tx_id", "file_name", "content")


def _terminal_pairs(spark, sf_dir) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    side = lambda data, src, dst: F.struct(data.alias("data"), tables.micros().alias("ts_us"), F.lit(src).alias("src"), F.lit(dst).alias("dst"))
    response = F.when(F.col("event_id") % 2 == 1, side(F.lit(b""), _ENDS[1], _ENDS[0]))
    return e.select(F.concat(F.lit("txn:"), F.col("event_id").cast("string")).alias("tx_id"), side(F.col("props").cast("binary"), *_ENDS).alias("request"), response.alias("response"))


@query("SELECT event_type AS metric, count(*) AS n FROM events GROUP BY event_type")
def metric_counters(spark, sf_dir):
    return metrics.counters(tables.read(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type AS metric, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, min(event_id) AS least, max(event_id) AS most FROM events GROUP BY event_type")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(tables.read(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT event_type AS metric, quantile_disc(event_id, 0.95) AS p95, quantile_disc(event_id, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    ranks = metrics.nearest_rank(tables.read(spark, sf_dir, "events"), "event_type", "event_id")
    return ranks.select("metric", F.col("p95").cast("long").alias("p95"), F.col("p99").cast("long").alias("p99"))


@query("""WITH v AS (SELECT user_id AS metric, list(CAST(event_id % 97 + 1 AS DOUBLE) ORDER BY event_id) AS l FROM events GROUP BY user_id)
    SELECT metric, round(list_reduce(l, lambda s, x: 0.85 * s + (1 - 0.85) * x), 6) AS ema FROM v""")
def ema(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 97 + 1).alias("v"))
    return metrics.ema(e, "user_id", "event_id", "v").select("metric", F.round("ema", 6).alias("ema"))


@query("SELECT event_id, max(event_id % 101) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_water FROM events")
def high_water(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 101).alias("v"))
    return metrics.high_water(e, "user_id", "event_id", "v").select("event_id", "high_water")


@query("SELECT event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active FROM events")
def active_sessions(spark, sf_dir):
    e = metrics.active(tables.read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "error")
    return e.select("event_id", F.col("active").cast("long").alias("active"))


@query("SELECT event_id, CASE WHEN length(props) > 4 THEN lower(hex(encode(substr(props, 1, 4)))) || '...' ELSE lower(hex(encode(props))) END AS preview FROM events")
def hexdump_preview(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", binary.hex_preview(F.col("props").cast("binary"), 4).alias("preview"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^\\x20-\\x7e\\t\\r\\n]', '', 'g')) / strlen(text), 9) AS ratio FROM documents")
def printable_ratio(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.round(binary.printable_ratio(F.col("text").cast("binary")), 9).alias("ratio"))


@query()
def murmur_hash(spark, sf_dir):
    """128-bit hashes, which SQL doesn't have; a test compares each with a plain version."""
    return tables.read(spark, sf_dir, "events").select("event_id", binary.murmur128(F.col("props").cast("binary")).alias("h"))


@query(f"WITH {SEGMENTS} SELECT arrival, ts_us, src_ip, src_port, dst_ip, dst_port, seq, flags, payload FROM segments")
def kafka_json_roundtrip(spark, sf_dir):
    s = tables.segments(spark, sf_dir)
    lines = feeds.segment_json(s, "arrival")
    back = feeds.parse_segments(lines, order=F.col("arrival"))
    return back.withColumn("payload", F.col("payload").cast("string"))


_SIDE_SQL = """'{direction}' AS {name}_direction, us AS {name}_ts, {length} AS {name}_length, {first} AS {name}_first, {head} AS {name}_headers, {body} AS {name}_body"""
_CRLF = "chr(13) || chr(10)"
_HEADS = ("'GET /a HTTP/1.1' || " + _CRLF + " || 'Host: h'", "'HTTP/1.1 200 OK' || " + _CRLF + " || 'Transfer-Encoding: chunked' || " + _CRLF + " || 'X:  y'")
_CODED = f"lower(to_hex(length(props))) || {_CRLF} || props || {_CRLF} || '0' || {_CRLF} || {_CRLF}"


@query(
    f"""WITH e AS (SELECT *, 'txn:' || event_id AS id, epoch_us(ts) AS us FROM events)
    SELECT id AS key, 'HTTP' AS protocol, id AS tx_id, us AS start_ts, us AS end_ts, '10.0.0.1' AS client_ip, 9 AS client_port, '10.1.0.1' AS server_ip, 80 AS server_port,
    {_SIDE_SQL.format(name="request", direction="REQUEST", length=f"length({_HEADS[0]}) + 4", first="'GET /a HTTP/1.1'", head=_HEADS[0], body="''")},
    {_SIDE_SQL.format(name="response", direction="RESPONSE", length=f"length({_HEADS[1]}) + 5 + length({_CODED})", first="'HTTP/1.1 200 OK'", head=_HEADS[1], body=_CODED)} FROM e"""
)
def pair_json_lines(spark, sf_dir):
    """Every field of the pairs' JSON, read back."""
    end = lambda ip, port: F.struct(F.lit(ip).alias("ip"), F.lit(port).alias("port"))
    pairs = _event_pairs(spark, sf_dir).select("*", end("10.0.0.1", 9).alias("client"), end("10.1.0.1", 80).alias("server"))
    side = "struct<timestamp: long, direction: string, length: int, firstLine: string, headers: string, bodyB64: string>"
    form = f"protocol string, txId string, startTs long, endTs long, client struct<ip: string, port: int>, server struct<ip: string, port: int>, request {side}, response {side}"
    p = feeds.pair_json(pairs, "HTTP").select("key", F.from_json("value", form).alias("p"))
    of = lambda s: [F.col(f"p.{s}.{c}").alias(f"{s}_{a}") for c, a in (("direction", "direction"), ("timestamp", "ts"), ("length", "length"), ("firstLine", "first"), ("headers", "headers"))] + [F.unbase64(F.col(f"p.{s}.bodyB64")).cast("string").alias(f"{s}_body")]
    return p.select("key", "p.protocol", F.col("p.txId").alias("tx_id"), F.col("p.startTs").alias("start_ts"), F.col("p.endTs").alias("end_ts"), F.col("p.client.ip").alias("client_ip"), F.col("p.client.port").alias("client_port"), F.col("p.server.ip").alias("server_ip"), F.col("p.server.port").alias("server_port"), *of("request"), *of("response"))


@query(
    f"""SELECT tx_id, 'HTTP REQUEST' || chr(10) || 'GET /a HTTP/1.1' || chr(10) || 'HTTP RESPONSE' || chr(10) || 'HTTP/1.1 200 OK' || chr(10) || props || chr(10) AS content FROM (SELECT 'txn:' || event_id AS tx_id, props FROM events)"""
)
def bus_pair_reports(spark, sf_dir):
    """Pairs as the bus carries them, written, read and reported."""
    end = F.struct(F.lit("10.0.0.1").alias("ip"), F.lit(80).alias("port"))
    lines = feeds.pair_json(_event_pairs(spark, sf_dir).select("*", end.alias("client"), end.alias("server")), "HTTP")
    return feeds.pair_reports(feeds.parse_pairs(lines), True)


@query(
    f"""WITH {ORIENTED}, s AS (SELECT *, payload <> '' AS filled, octet_length(encode(payload)) AS size FROM flow),
    -- sequence numbers rise with arrival and leave gaps, so a flow side's first payload is released and all others wait
    r AS (SELECT *, filled AND row_number() OVER (PARTITION BY flow_id, from_client, filled ORDER BY arrival) = 1 AS released FROM s)
    SELECT 'live.segment.accepted' AS metric, count(*) FILTER (NOT (payload = '' AND flags & 31 = 16)) AS n, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS least, CAST(NULL AS BIGINT) AS most FROM s
    UNION ALL SELECT 'capture.segment.skipped.pureAck', count(*) FILTER (payload = '' AND flags & 31 = 16), NULL, NULL, NULL FROM s
    UNION ALL SELECT 'live.byteStream.bytes', count(*), CAST(sum(size) AS BIGINT), min(size), max(size) FROM s WHERE filled
    """
    + "".join(
        f"""UNION ALL SELECT 'live.flowAssembler.{side}.duplicate', 0, NULL, NULL, NULL
    UNION ALL SELECT 'live.flowAssembler.{side}.stored', count(*) FILTER (filled), NULL, NULL, NULL FROM r WHERE {own}
    UNION ALL SELECT 'live.flowAssembler.{side}.buffered', count(*) FILTER (filled AND NOT released), NULL, NULL, NULL FROM r WHERE {own}
    UNION ALL SELECT 'live.flowAssembler.{side}.contiguous', count(*) FILTER (released), NULL, NULL, NULL FROM r WHERE {own}
    UNION ALL SELECT 'live.flowAssembler.{side}.bytes', count(*), CAST(sum(size) AS BIGINT), min(size), max(size) FROM r WHERE released AND {own}
    """
        for side, own in (("client", "from_client"), ("server", "NOT from_client"))
    )
)
def observed_metrics(spark, sf_dir):
    """Counts and histograms that a job's rows give in passing."""
    from pyspark.sql import Observation

    seen, done = Observation(), Observation()
    s = metrics.observed(tables.segments(spark, sf_dir), seen, *metrics.segment_metrics())
    metrics.observed(reassembly.outcomes(flows.orient(s)), done, *metrics.assembler_metrics()).write.format("noop").mode("overwrite").save()
    found = metrics.merged([seen.get, done.get])
    values = [(k, v["n"], v["total"], v["least"], v["most"]) if isinstance(v, dict) else (k, v, None, None, None) for k, v in found.items()]
    return spark.createDataFrame(values, "metric string, n long, total long, least long, most long")


@query(
    """SELECT 'txn:' || event_id AS tx_id, epoch_us(ts) AS start_ts, props AS request, epoch_us(ts) AS request_ts, '' AS first_line, CASE WHEN event_id % 2 = 1 THEN epoch_us(ts) ELSE 0 END AS response_ts, '' AS response FROM events"""
)
def bus_terminal_pairs(spark, sf_dir):
    """Terminal pairs as the bus carries them, with and without an answer, read back."""
    end = lambda port: F.struct(F.lit("10.0.0.1").alias("ip"), F.lit(port).alias("port"))
    lines = feeds.pair_json(_terminal_pairs(spark, sf_dir).select("*", end(9).alias("client"), end(23).alias("server")), "TN3270")
    p = feeds.parse_pairs(lines)
    return p.select("tx_id", "start_ts", F.col("request.data").cast("string").alias("request"), F.col("request.ts_us").alias("request_ts"), "request.first_line", F.col("response.ts_us").alias("response_ts"), F.col("response.data").cast("string").alias("response"))


@query(
    f"""WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id, type ORDER BY ord) AS n FROM messages)
    SELECT q.flow_id AS session_key, q.n * 2 AS n, 'terminal.event timestamp=' || strftime(make_timestamp(q.ts_us), '%Y-%m-%d %H:%M:%S') || CASE WHEN q.ts_us % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(q.ts_us % 1000000 AS VARCHAR), 6, '0'), '0') END
      || ', type=terminal.submit, terminal=T, session=T, source=tn3270, app=tn3270, operator=SMITH, attributes=[input.user=SMITH;screen.cols=80;screen.id=USR;screen.name=USER;screen.rows=24;tn3270.aid=ENTER]' AS line
    FROM k q JOIN k p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'"""
)
def terminal_event_log(spark, sf_dir):
    """Terminal events as lines; ids and hashes, which SQL can't compute, are replaced."""
    loaded = screens.load_screens("version: 1\nscreens: [{id: USR, match: [{position: {row: 1, column: 2, length: 5}, equals: 'USER:'}]}]")
    u = screens.terminal_user_events(terminal.terminal_events(_screens(spark, sf_dir)), loaded, keep=("session_key", "n"))
    same = u.withColumns({"terminal_id": F.lit("T"), "session_id": F.lit("T"), "attributes": F.map_filter("attributes", lambda k, _: k != "screen.hash")})
    return screens.log_line(same, "session_key", "n")


@query(f"WITH {MESSAGES} SELECT flow_id, ord, type, text AS body, '' AS headers, 'a:1' AS src, 'b:2' AS dst, ts_us, left(lower(hex(encode(text))), 32) || CASE WHEN octet_length(encode(text)) > 16 THEN '...' ELSE '' END AS first_line FROM messages")
def blob_store_roundtrip(spark, sf_dir):
    """Messages to blobs and index lines in the shared folder, in two jobs, and back by ranges."""
    m = tables.messages(spark, sf_dir).select("*", F.concat_ws("/", "flow_id", F.col("ord").cast("string")).alias("tx_id"), F.lit("a:1").alias("src"), F.lit("b:2").alias("dst"), F.lit("TN3270").alias("protocol"))
    folder = scratch_folder(spark)
    for part in (0, 1):
        store.write_store(m.where(F.col("ord") % 2 == part), folder)
    back = store.with_blobs(detect.index_entries_of(store.read_index(spark, folder), "TN3270"), folder)
    return back.select(F.col("session").alias("flow_id"), F.substring_index("id", "/", -1).cast("long").alias("ord"), F.col("kind").alias("type"), F.col("body").cast("string").alias("body"), F.col("headers").cast("string").alias("headers"), "src", "dst", F.col("ts_first").alias("ts_us"), "first_line")


@query(
    f"WITH {HTTP_EVENTS} SELECT 'q' || event_id AS id, substr(q, 1, strpos(q, chr(13)) - 1) AS first_line, q AS headers, '' AS body FROM ev UNION ALL SELECT 'p' || event_id, substr(p, 1, strpos(p, chr(13)) - 1), substr(p, 1, length(p) - length(props)), props FROM ev"
)
def http_blob_store(spark, sf_dir):
    """Heads and bodies of HTTP messages to the store and back."""
    q, p = tables.event_messages()
    side = lambda text, mark, kind, rank: F.struct(F.concat(F.lit(mark), F.col("event_id").cast("string")).alias("tx_id"), F.lit(kind).alias("type"), text.cast("binary").alias("data"), (F.col("event_id") * 2 + rank).alias("ord"))
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("flow_id"), tables.micros().alias("ts_us"), F.explode(F.array(side(q, "q", "REQUEST", 0), side(p, "p", "RESPONSE", 1))).alias("m"))
    m = e.select("flow_id", "ts_us", "m.*", F.lit("a:1").alias("src"), F.lit("b:2").alias("dst"), F.lit("HTTP").alias("protocol"))
    folder = scratch_folder(spark)
    store.write_store(m, folder, 1 << 20)
    back = store.with_blobs(detect.index_entries_of(store.read_index(spark, folder), "HTTP"), folder)
    return back.select("id", "first_line", F.col("headers").cast("string").alias("headers"), F.col("body").cast("string").alias("body"))


@query(f"WITH {SEGMENTS} SELECT ts_us, src_ip, src_port, dst_ip, dst_port, seq, flags, payload FROM segments")
def segbin_roundtrip(spark, sf_dir):
    """Segments to files of segment records and back."""
    capture.register(spark)
    folder = scratch_folder(spark)
    tables.segments(spark, sf_dir).write.format("segbin").mode("append").option("path", folder).option("rollMiB", 1).save()
    return spark.read.format("segbin").load(folder).drop("arrival").withColumn("payload", F.col("payload").cast("string"))


@query(f"WITH {SEGMENTS} SELECT seq, payload FROM segments WHERE ((src_port = 23 OR dst_port = 23) OR src_ip = '10.0.0.8') AND ts_us < 1704500000000000")
def capture_filter_scan(spark, sf_dir):
    """Segment files read in splits of 64 KiB, by a capture filter and times that are decided in the scan."""
    capture.register(spark)
    folder = scratch_folder(spark)
    tables.segments(spark, sf_dir).write.format("segbin").mode("append").option("path", folder).save()
    s = spark.read.format("segbin").option("splitBytes", 1 << 16).option("filter", "tcp and (port 23 or src host 10.0.0.8)").option("untilUs", 1_704_500_000_000_000).load(folder)
    return s.select("seq", F.col("payload").cast("string").alias("payload"))


@query(
    """SELECT event_id, 'T' || user_id AS key, 1 AS schema_version, CASE WHEN event_id % 2 = 0 THEN 'SCREEN_RENDER' ELSE 'USER_SUBMIT' END AS type, CASE WHEN event_id % 2 = 0 THEN 'screen-renders' ELSE 'user-actions' END AS topic,
    CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'ENTER' END AS aid, CASE WHEN event_id % 2 = 0 THEN 24 END AS rows, CASE WHEN event_id % 2 = 1 THEN event_type END AS typed, CASE WHEN event_id % 2 = 0 THEN '[]' END AS fields, 'MAIN' AS screen_name, 's' AS session_id, 26 AS id_length, 'terminal-assembler' AS source FROM events"""
)
def terminal_event_json(spark, sf_dir):
    """Terminal events' envelopes, read back."""
    submit = F.col("event_id") % 2 == 1
    e = tables.read(spark, sf_dir, "events").select(
        F.lit("s").alias("session_id"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("session_key"), F.col("event_id").alias("n"), F.when(submit, "USER_SUBMIT").otherwise("SCREEN_RENDER").alias("type"), tables.micros().alias("ts_us"),
        F.lit("ENTER").alias("aid"), F.create_map(F.lit("NAME:"), F.col("event_type")).alias("inputs"), F.lit(24).alias("rows"), F.lit(80).alias("cols"), F.lit(None).cast(f"array<struct<{terminal.FIELD}>>").alias("fields"), F.lit("h").alias("screen_hash"), F.lit("MAIN").alias("screen_name"),
    )
    lines = feeds.terminal_json(e.select("*", F.lit("").alias("plain_text")), emitted=F.timestamp_micros("ts_us"))
    at = lambda path: F.get_json_object("value", path)
    # The event's number is in no field of the envelope but its id's hash, so it is joined by the id.
    ids = e.select(F.col("n").alias("event_id"), feeds.event_id(F.col("ts_us"), F.col("session_key"), F.col("n").cast("string")).alias("id"))
    return lines.join(ids, at("$.eventId") == F.col("id")).select(
        "event_id", "key", at("$.schemaVersion").cast("int").alias("schema_version"), at("$.type").alias("type"), "topic", at("$.tn3270.aid").alias("aid"), at("$.tn3270.rows").cast("int").alias("rows"), at("$.tn3270.inputs['NAME:']").alias("typed"),
        at("$.tn3270.fields").alias("fields"), at("$.tn3270.screenName").alias("screen_name"), at("$.session.sessionId").alias("session_id"), F.length("id").alias("id_length"), at("$.pipeline.source").alias("source"),
    )


@query("""WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS f, turn, strlen(coalesce(text, '')) AS size, least(strlen(coalesce(text, '')), 10) AS head FROM conversations)
    SELECT f AS session, turn AS ord, CAST(coalesce(sum(size) OVER (PARTITION BY f ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS headers_off, CAST(head AS BIGINT) AS headers_len,
    CAST(coalesce(sum(size) OVER (PARTITION BY f ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS BIGINT) AS body_off, CAST(size - head AS BIGINT) AS body_len FROM m""")
def index_offsets(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("flow_id", "ord", "type", "data", F.col("ord").alias("ts_us"), F.lit("x").alias("tx_id"))
    return store.index_lines(m, "blob", F.least(F.octet_length("data"), F.lit(10))).select("session", F.col("ts_first").alias("ord"), "headers_off", "headers_len", "body_off", "body_len")


@query(f"SELECT event_id, {_DUMP.format('props', 8)} AS dump FROM events")
def hex_dump_lines(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", binary.hex_dump(F.col("props").cast("binary"), 8).alias("dump"))


@query("SELECT event_id, props AS body FROM events")
def chunked_decode(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    coded = F.concat(F.lower(F.hex(F.length("props"))), F.lit(";x=1\r\n"), F.col("props"), F.lit("\r\n0\r\nT: 1\r\n\r\n"))
    return e.select("event_id", binary.dechunked(coded.cast("binary")).cast("string").alias("body"))


@query("SELECT event_id, event_id % 2 = 0 AS valid FROM events")
def json_strictness(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit(" junk")))
    return e.select("event_id", binary.strict_variant(text).isNotNull().alias("valid"))


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'unknown' ELSE regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') END AS name FROM pages")
def safe_file_names(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", binary.safe_name(F.when(F.col("page_id") % 10 != 0, F.col("url")).when(F.col("page_id") % 20 == 0, " \t")).alias("name"))


@query(f"WITH {ORIENTED}, d AS (SELECT DISTINCT flow_id, conv, client, flow_seq FROM flow) SELECT client, count(*) AS flows FROM d GROUP BY client")
def flows_by_client(spark, sf_dir):
    return _oriented(spark, sf_dir).select("flow_id", "client").distinct().groupBy("client").agg(F.count("*").alias("flows"))


@query("SELECT event_type AS metric, count(*) AS waits, CAST(sum(event_id % 50) AS BIGINT) AS total FROM events GROUP BY event_type")
def queue_waits(spark, sf_dir):
    return metrics.waits(tables.read(spark, sf_dir, "events"), "event_type", F.col("event_id") % 50)


@query(f"WITH {SEGMENTS} SELECT count(*) AS scanned, CAST(sum(CASE WHEN contains(payload, '\"k\": 7') THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM segments")
def grep_totals(spark, sf_dir):
    return metrics.grep_totals(tables.segments(spark, sf_dir), b'"k": 7')


@query("SELECT doc_id, left(text, (SELECT max(n) FROM range(41) r(n) WHERE octet_length(encode(left(text, n))) <= 40)) AS clamped, true AS fits FROM documents")
def utf8_clamp(spark, sf_dir):
    """Texts cut to 40 bytes at whole characters; what is cut is checked to be the longest such prefix."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "text", binary.clamp_utf8(F.col("text"), 40).alias("c"))
    whole = F.octet_length("text") <= 40
    longer = F.expr("octet_length(substring(text, 1, length(c) + 1)) > 40")
    fits = F.when(whole, F.col("c") == F.col("text")).otherwise(F.startswith("text", F.col("c")) & (F.octet_length("c") <= 40) & longer)
    return d.select("doc_id", F.col("c").alias("clamped"), fits.alias("fits"))


@query(f"WITH {SEGMENTS} SELECT arrival, ts_us, src_ip, src_port, dst_ip, dst_port, seq, flags, payload FROM segments")
def pcap_frames(spark, sf_dir):
    """Segments as frames of capture files in the shared folder, with frames that are none between them, read and decoded."""
    folder = scratch_folder(spark)
    capture.write_frames(tables.segments(spark, sf_dir), folder, every_junk=10)
    s = capture.decode_frames(spark.read.format("pcap").load(folder), wide=True)
    # The order of arrival is that of the files and their records; the sequence number is the event's.
    return s.withColumn("arrival", F.expr("seq div 16")).withColumn("payload", F.col("payload").cast("string"))


@query("SELECT n_nationkey AS id, '/n/' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 200 END AS status, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1000 ELSE -1 END AS BIGINT) AS latency_us, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS body FROM nation")
def sample_exchanges(spark, sf_dir):
    """Text samples of requests, every other one with a response, as exchanges."""
    folder = scratch_folder(spark)
    name = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    file = lambda kind, content: F.struct(F.concat(name, F.lit(f"-{kind}.txt")).alias("file_name"), content.alias("content"))
    request = file("request", F.concat(F.lit("GET /n/"), F.col("n_nationkey").cast("string"), F.lit(" HTTP/1.1\nHost: x\n\n")))
    response = F.when(F.col("n_nationkey") % 2 == 0, file("response", F.concat(F.lit("HTTP/1.1 200 OK\n\n"), F.col("n_name"))))
    reports.write_reports(tables.read(spark, sf_dir, "nation").select(F.explode(F.array_compact(F.array(request, response))).alias("f")).select("f.*"), folder)
    x = http.exchanges(feeds.samples(spark, folder))
    return x.select(F.substring("flow_id", 2, 4).cast("int").cast("long").alias("id"), "http_request.path", "http_response.status", "latency_us", F.col("http_response.body").cast("string").alias("body"))


@query(f"WITH e AS (SELECT 'n:' || n_nationkey AS id, n_nationkey AS us, n_name AS props FROM nation) SELECT {_HTTP_REPORT} FROM e")
def report_files(spark, sf_dir):
    """Reports as files in the shared folder, read back."""
    folder = scratch_folder(spark)
    n = tables.read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("tx_id"), F.col("n_nationkey").cast("long").alias("ts_us"), F.col("n_name").alias("props"))
    reports.write_reports(reports.http_reports(_reported(n)), folder)
    return spark.read.text(f"{folder}/*.http", wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("file_name"))


@query("SELECT tx_id AS key, content AS value FROM (" + ORACLE["http_report_text"] + ")")
def report_bus_lines(spark, sf_dir):
    return feeds.report_lines(reports.http_reports(_event_pairs(spark, sf_dir)))


@query("SELECT protocol, tx_id, content FROM (" + ORACLE["http_report_text"] + ") UNION ALL SELECT 'TN3270', tx_id, content FROM (" + ORACLE["terminal_report_text"] + ")")
def report_union(spark, sf_dir):
    """Reports of both protocols in one table."""
    http_side, terminal_side = reports.http_reports(_event_pairs(spark, sf_dir)), reports.terminal_reports(_terminal_pairs(spark, sf_dir))
    return http_side.unionByName(terminal_side).select("protocol", "tx_id", "content")


@query(
    """SELECT 'user.event type=user.buy, rule=buy, ruleDesc=Somebody buys, session=' || CASE WHEN event_id % 4 = 0 THEN 's' || user_id ELSE 'DERIVED-' || upper(substr(sha256('10.0.0.' || user_id % 250 || '|agent' || event_id % 3 || '|' || CAST(floor(epoch_us(ts) / 900000000) AS BIGINT)), 1, 24)) END
    || ', auth=AUTHENTICATED, user=' || user_id || ', source=gateway, app=demo, method=POST, path=/u/' || user_id || '/purchase, status=200, latencyMs=1, attributes=[agent=agent' || event_id % 3 || ';channel=web;key=' || event_id % 9 || ']' AS line FROM events WHERE event_type = 'purchase'"""
)
def user_event_log(spark, sf_dir):
    m = rules.evaluate(_event_exchanges(spark, sf_dir), rules.load_rules(RULES)).where("rule_id = 'buy'")
    return rules.log_line(rules.user_events(m))


@query(f"WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id, type ORDER BY ord) AS n FROM messages) SELECT q.flow_id AS session_key, q.n * 2 AS n, 'SMITH' AS operator_id, 'USR' AS screen_id, 'SMITH' AS typed, 'ENTER' AS aid, 'USER' AS screen_name, q.ts_us FROM k q JOIN k p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'")
def terminal_user_events(spark, sf_dir):
    """Submits with their screen's rule, operator and attributes."""
    e = terminal.terminal_events(_screens(spark, sf_dir))
    loaded = screens.load_screens("version: 1\nscreens: [{id: USR, match: [{position: {row: 1, column: 2, length: 5}, equals: 'USER:'}]}]")
    u = screens.terminal_user_events(e, loaded, keep=("session_key", "n", "ts_us"))
    a = lambda k: F.col("attributes")[k]
    return u.select("session_key", "n", "operator_id", a("screen.id").alias("screen_id"), a("input.user").alias("typed"), a("tn3270.aid").alias("aid"), a("screen.name").alias("screen_name"), "ts_us")


@query(f"WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id, type ORDER BY ord) AS n FROM messages) SELECT q.flow_id AS session_key, q.n, 12 + CAST(p.ord % 3 AS INT) AS rows, 40 AS cols, 'A' AS text FROM k q JOIN k p ON q.flow_id = p.flow_id AND q.n = p.n AND q.type = 'REQUEST' AND p.type = 'RESPONSE'")
def terminal_shapes(spark, sf_dir):
    """Structured fields that shape the screen and write to it."""
    from ..functions import ebcdic

    field = F.concat(F.lit(bytes([terminal.STRUCTURED, 0, 0, 8, terminal.READ_BUFFER, 0, 0])), F.unhex(F.hex(F.col("ord") % 3 + 12)), F.lit(bytes([40]) + ebcdic.encode("A")))
    m = tables.messages(spark, sf_dir).select("flow_id", "ord", "type", F.when(F.col("type") == "REQUEST", F.lit(b"\x6d")).otherwise(field).alias("data"), "ts_us")
    e = terminal.terminal_events(pairing.two_way_pairs(m)).where("type = 'SCREEN_RENDER'")
    return e.select("session_key", ((F.col("n") + 1) / 2).cast("long").alias("n"), "rows", "cols", F.regexp_replace("plain_text", "\n+$", "").alias("text"))


@query("SELECT CAST(user_id % 50 AS VARCHAR) AS flow_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS ord, 'RESPONSE' AS type, props || chr(255) AS data FROM events")
def telnet_framing(spark, sf_dir):
    """Records with escaped marks, options and sub-negotiations, in slices that cut them anywhere."""
    return terminal.frame_records(_telnet_slices(spark, sf_dir, F.col("user_id") % 50)).select("flow_id", "ord", "type", F.decode("data", "ISO-8859-1").alias("data"))


def _telnet_slices(spark: SparkSession, sf_dir: str, flow) -> DataFrame:
    mark = lambda *b: F.lit(bytes([terminal.IAC, *b]))
    whole = F.concat(mark(0xFB, 25), F.expr("cast(substring(props, 1, 3) as binary)"), mark(terminal.SB, 1, 2, terminal.IAC, terminal.SE), F.expr("cast(substring(props, 4) as binary)"), mark(terminal.IAC), mark(terminal.EOR))
    s = tables.read(spark, sf_dir, "events").select(flow.cast("string").alias("flow_id"), "event_id", whole.alias("w"), tables.micros().alias("ts_us"))
    cut = (F.col("event_id") % 12 + 1).cast("int")
    parts = F.array(F.struct((F.col("event_id") * 2).alias("arrival"), F.substring("w", F.lit(1), cut).alias("data")), F.struct((F.col("event_id") * 2 + 1).alias("arrival"), F.substring("w", cut + 1, F.octet_length("w")).alias("data")))
    return s.select("flow_id", "ts_us", F.explode(parts).alias("p")).select("flow_id", "p.arrival", F.lit(False).alias("from_client"), "p.data", "ts_us")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, 'RESPONSE' AS type, props || chr(255) AS data FROM events")
def hot_telnet_flow(spark, sf_dir):
    """The same records as those of one flow, framed by ranges of its slices."""
    return telnet_ranges.frame_records(_telnet_slices(spark, sf_dir, F.lit(1)), 700).select("ord", "type", F.decode("data", "ISO-8859-1").alias("data"))


@query(f"WITH {FLOW_MESSAGES}, swapped AS (SELECT flow_id, ord, CASE WHEN type = 'REQUEST' THEN 'RESPONSE' ELSE 'REQUEST' END AS type, ts_us FROM messages){LINDLEY.replace('FROM messages', 'FROM swapped')} SELECT flow_id, ord, substr(sha256(flow_id || '|' || coalesce('t' || n, 'o' || ord)), 1, 26) AS tx_id FROM numbered")
def tx_id_by_response(spark, sf_dir):
    """Transaction ids that the host's messages mint."""
    return pairing.with_tx_id(_flow_messages(spark, sf_dir), "RESPONSE", BY_CONVERSATION).select("flow_id", "ord", "tx_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'HDR:' || user_id WHEN event_id % 3 = 1 THEN 'SID:c' || user_id END AS by_request, CASE WHEN event_id % 2 = 0 THEN 'SID:' || event_type END AS by_response FROM events")
def session_extraction(spark, sf_dir):
    """Sessions from header patterns, cookies and what responses set."""
    text = F.col("user_id").cast("string")
    headers = F.create_map(F.lit("x-token"), F.array(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("v="), text)).otherwise("none")), F.lit("cookie"), F.array(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("a=1; SID = c"), text)).otherwise("b=2")))
    sets = F.array(F.lit("x=1; Path=/"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sid="), F.col("event_type"), F.lit("; Secure"))).otherwise("y=2"))
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", rules.extract_session(headers, ["x-token: v=(\\d+)"], ["sid"]).alias("by_request"), rules.extract_set_session(sets, ["sid"]).alias("by_response"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'née ' || event_type ELSE 'zip ' || event_type END AS body FROM events")
def body_decoding(spark, sf_dir):
    """Bodies in several charsets, and compressed ones."""
    import gzip
    import zlib

    kind = F.expr("event_type")
    names = ("view", "click", "signup", "purchase", "error")
    plain = F.concat(F.lit("née "), kind)
    charset = F.element_at(F.array(*map(F.lit, ("ISO-8859-1", "UTF-8", "utf-16le", "windows-1252"))), (F.col("event_id") / 2 % 4 + 1).cast("int"))
    coded = F.when(F.lower(charset) == "utf-8", F.encode(plain, "UTF-8")).when(F.lower(charset) == "utf-16le", F.encode(plain, "UTF-16LE")).otherwise(F.encode(plain, "ISO-8859-1"))
    text = http.body_text(coded, F.concat(F.lit("text/plain; charset="), charset))
    packed = lambda pack, name: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(b"HTTP/1.1 200 OK\r\nContent-Encoding: " + name + b"\r\n\r\n" + pack(f"zip {n}".encode())) for n in names)))[kind]
    message = F.when(F.col("event_id") % 4 == 1, packed(gzip.compress, b"gzip")).otherwise(packed(zlib.compress, b"deflate"))
    unpacked = F.substring_index(reports._decoded(message, "all").cast("string"), "\r\n", -1)
    return tables.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, text).otherwise(unpacked).alias("body"))


@query("SELECT CASE WHEN n % 3 = 0 THEN 'HTTP' ELSE 'TN3270' END AS protocol, count(*) AS n FROM (SELECT event_id AS n FROM events) WHERE n % 3 < 2 GROUP BY 1")
def routed_stores(spark, sf_dir):
    """Rows of enabled protocols to the store of theirs, read back; those of no store go nowhere."""
    kind = F.element_at(F.array(*map(F.lit, ("HTTP", "TN3270", "UNKNOWN"))), (F.col("event_id") % 3 + 1).cast("int"))
    e = tables.read(spark, sf_dir, "events").select("event_id", kind.alias("protocol"))
    # A protocol that is switched off, and one that has no store.
    e = detect.only_enabled(e.union(e.where("protocol = 'HTTP'").withColumn("protocol", F.lit("OFF"))), ["HTTP", "TN3270", "UNKNOWN"])
    folders = {p: scratch_folder(spark) for p in ("HTTP", "TN3270", "OFF")}
    feeds.route(e, {p: (lambda rows, f=f: rows.write.mode("append").parquet(f)) for p, f in folders.items()})
    return spark.read.schema("event_id long, protocol string").parquet(*folders.values()).groupBy("protocol").agg(F.count("*").alias("n"))


@query("SELECT event_id, '{\"protocol\":\"' || CASE WHEN event_id % 2 = 0 THEN 'HTTP' ELSE 'TN3270' END || '\"}' AS value FROM events")
def protocol_pair_lines(spark, sf_dir):
    """Protocols of pairs as lines, all of which a full sample keeps."""
    e = tables.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "HTTP").otherwise("TN3270").alias("protocol"))
    return feeds.protocol_lines(terminal.sampled(e, 2.0, F.col("event_id")), "event_id")


@query("SELECT event_id AS arrival FROM events")
def disabled_source(spark, sf_dir):
    """A source that is switched off, beside one that isn't."""
    from ..schemas import SEGMENT

    return feeds.disabled(spark, SEGMENT).unionByName(tables.segments(spark, sf_dir)).select("arrival")


FIELD_RULES = """
version: 1
rules:
  - {id: header, match: {header: {user-agent: {equals: agent1}}}}
  - {id: cookie, match: {cookie: {jsessionid: {regex: '^s[0-9]*5$'}}}}
  - {id: query, match: {query: {k: '3'}}}
  - {id: answer, match: {responseHeader: {content-type: {contains: json}}, status: 500}}
  - {id: prefix, match: {path: {prefix: /u/1}, method: [post]}}
  - {id: part, match: {path: {contains: /click}}}
  - {id: body, match: {responseBody: {contains: '7'}}}
  - {id: shape, match: {responseBody: {regex: '"k": [0-9]}$'}}}
  - {id: lack, match: {responseBody: {jsonpath: [{path: $.none, exists: false}]}, query: {k: '0'}}}
"""


@query(r"""SELECT CAST(event_id AS VARCHAR) AS flow_id, rule_id FROM (SELECT *, unnest([CASE WHEN event_id % 3 = 1 THEN 'header' END, CASE WHEN event_id % 4 = 0 AND user_id % 10 = 5 THEN 'cookie' END, CASE WHEN event_id % 9 = 3 THEN 'query' END,
    CASE WHEN event_type = 'error' THEN 'answer' END, CASE WHEN event_type = 'purchase' AND starts_with(CAST(user_id AS VARCHAR), '1') THEN 'prefix' END, CASE WHEN event_type = 'click' THEN 'part' END, CASE WHEN contains(props, '7') THEN 'body' END,
    CASE WHEN regexp_matches(props, '"k": [0-9]\}$') THEN 'shape' END, CASE WHEN event_id % 9 = 0 THEN 'lack' END]) AS rule_id FROM events) WHERE rule_id IS NOT NULL""")
def rule_fields(spark, sf_dir):
    """Predicates over headers, cookies, parameters, paths, response fields and bodies."""
    return rules.evaluate(_event_exchanges(spark, sf_dir), rules.load_rules(FIELD_RULES)).select("flow_id", "rule_id")
