"""Schemas of the tables that operators exchange, as Spark DDL."""

FRAME = "arrival BIGINT, ts_us BIGINT, data BINARY"
SEGMENT = "arrival BIGINT, ts_us BIGINT, src_ip STRING, src_port INT, dst_ip STRING, dst_port INT, seq BIGINT, flags INT, payload BINARY"
SLICE = "flow_id STRING, arrival BIGINT, from_client BOOLEAN, data BINARY, ts_us BIGINT"
MESSAGE = "flow_id STRING, ord BIGINT, protocol STRING, type STRING, data BINARY, ts_us BIGINT, tx_id STRING"
SEGMENT_JSON = "ts BIGINT, src STRING, sport INT, dst STRING, dport INT, seq BIGINT, flags INT, payload STRING"
INDEX = "id STRING, kind STRING, ts_first BIGINT, ts_last BIGINT, session STRING, src STRING, dst STRING, first_line STRING, headers_blob STRING, headers_off BIGINT, headers_len BIGINT, body_blob STRING, body_off BIGINT, body_len BIGINT"
REPORT = "protocol STRING, tx_id STRING, ts_us BIGINT, content STRING"

# Bits of a persisted segment's flags.
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
FLAGS = {"fin": FIN, "syn": SYN, "rst": RST, "psh": PSH, "ack": ACK}
