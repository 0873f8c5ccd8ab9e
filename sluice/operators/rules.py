"""User-event rules: YAML to columns, every match an event; sessions and event assembly."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import strict_variant
from .http import body_text, first_value, trimmed

METHODS_TYPE = "method must be a string or a list of strings"
_STEP = re.compile(r"""\s+|\.([A-Za-z0-9_$-]+)|\[\s*(?:'((?:[^'\\]|\\.)+)'|"((?:[^"\\]|\\.)+)"|(\d+))\s*\]""", re.DOTALL)
SESSION_BUCKET_US = 15 * 60 * 1_000_000


def json_path(path: str) -> str:
    """A path of names and indexes in the form that variant functions take; anything else is an error.

    White space may stand between the steps and inside brackets; a backslash takes the next character as it is.  A name
    with both kinds of quotes can't be written for variant functions and is an error too.
    """
    path = path.strip()
    if not path.startswith("$"):
        raise ValueError(f"path must begin with $: {path}")
    at, out = 1, "$"
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unsupported path: {path}")
        at = m.end()
        if m[4]:
            out += f"[{int(m[4])}]"
        elif m[1] or m[2] or m[3]:
            name = m[1] or re.sub(r"\\(.)", r"\1", m[2] or m[3], flags=re.DOTALL)
            if "'" in name and '"' in name:
                raise ValueError(f"unsupported path: {path}")
            out += f'["{name}"]' if "'" in name else f"['{name}']"
    return out


def java_regex(pattern: str) -> str:
    return re.sub(r"\(\?P<", "(?<", pattern)


def _group(pattern: str, name: str) -> int | None:
    return re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groupindex.get(name)


@dataclass(frozen=True)
class Exchange:
    """The columns that predicates and extractors read; the body and its JSON are parsed once, for all rules."""

    request: str = "http_request"
    response: str = "http_response"

    def body(self, side: str) -> Column:
        name = self.request if side == "request" else self.response
        return F.col(f"_{name}_text")

    def json(self, side: str) -> Column:
        name = self.request if side == "request" else self.response
        return F.col(f"_{name}_json")


def prepare_bodies(exchanges: DataFrame, x: Exchange = Exchange()) -> DataFrame:
    """Adds the text and the JSON of both bodies; of an object's members of one name the last counts."""
    exchanges.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    out = exchanges
    for name in (x.request, x.response):
        out = out.withColumn(f"_{name}_text", body_text(F.col(f"{name}.body"), first_value(F.col(f"{name}.headers"), "content-type")))
    return out.withColumns({f"_{n}_json": strict_variant(F.col(f"_{n}_text")) for n in (x.request, x.response)})


def load_rules(*texts: str) -> dict:
    """Rules of one or several YAML documents: later defaults win, ids are unique, only version 1 counts."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("rules in YAML need PyYAML") from e
    defaults, rules, ids = {}, [], set()
    for text in texts:
        doc = yaml.safe_load(text) or {}
        if doc.get("version") != 1:
            raise ValueError(f"unsupported version: {doc.get('version')}")
        defaults |= {k: str(v) for k, v in (doc.get("defaults") or {}).items()}
        for rule in doc.get("rules") or []:
            if rule["id"] in ids:
                raise ValueError(f"duplicate rule id: {rule['id']}")
            ids.add(rule["id"])
            methods = (rule.get("match") or {}).get("method", [])
            if not isinstance(methods, (str, list)) or not all(isinstance(m, str) for m in (methods if isinstance(methods, list) else [methods])):
                raise ValueError(METHODS_TYPE)
            rules.append(rule)
    return {"defaults": defaults, "rules": rules}


def load_rule_files(*paths: str) -> dict:
    return load_rules(*(Path(p).read_text(encoding="utf-8") for p in paths))


def _text_test(value: Column, spec) -> Column:
    """equals, contains or regex (found anywhere) on a text that is there."""
    if not isinstance(spec, dict):
        return value == str(spec)
    tests = []
    if "equals" in spec:
        tests.append(value == str(spec["equals"]))
    if "contains" in spec:
        tests.append(F.contains(value, F.lit(str(spec["contains"]))))
    if "regex" in spec:
        tests.append(F.rlike(value, F.lit(java_regex(spec["regex"]))))
    return _all(tests)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _path_test(path: Column, spec) -> Column:
    if not isinstance(spec, dict):
        return path == str(spec)
    tests = []
    for key, value in spec.items():
        if key == "equals":
            tests.append(path == value)
        elif key == "prefix":
            tests.append(F.startswith(path, F.lit(value)))
        elif key == "contains":
            tests.append(F.contains(path, F.lit(value)))
        elif key == "regex":
            tests.append(F.rlike(path, F.lit(rf"\A(?:{java_regex(value)})\z")))
    return _all(tests)


def _json_tests(document: Column, specs) -> list[Column]:
    out = []
    for spec in specs if isinstance(specs, list) else [specs]:
        path = json_path(spec["path"])
        value = F.try_variant_get(document, path, "string")
        if "equals" in spec:
            out.append(value == str(spec["equals"]))
        if spec.get("regex"):
            out.append(F.rlike(value, F.lit(java_regex(spec["regex"]))))
        if "exists" in spec:
            out.append(value.isNotNull() if spec["exists"] else document.isNotNull() & value.isNull())
        elif "equals" not in spec and not spec.get("regex"):
            out.append(value.isNotNull())
    return out


def match(rule: dict, x: Exchange = Exchange()) -> Column:
    """Whether an exchange meets all sections of a rule, cheap ones first."""
    m = rule.get("match") or {}
    req, rsp = F.col(x.request), F.col(x.response)
    tests = []
    if "method" in m:
        methods = m["method"] if isinstance(m["method"], list) else [m["method"]]
        tests.append(F.upper(req["method"]).isin(*(v.upper() for v in methods)))
    if "path" in m:
        tests.append(_path_test(req["path"], m["path"]))
    if "status" in m:
        allowed = m["status"]["in"] if isinstance(m["status"], dict) else m["status"] if isinstance(m["status"], list) else [m["status"]]
        tests.append(rsp["status"].isin(*(int(v) for v in allowed)))
    for section, side, column in (("header", req, "headers"), ("headers", req, "headers"), ("cookie", req, "cookies"), ("query", req, "query"), ("responseHeader", rsp, "headers")):
        for name, spec in (m.get(section) or {}).items():
            value = first_value(side[column], name.lower()) if column == "headers" else F.try_element_at(side[column], F.lit(name.lower()))
            tests.append(_text_test(value, spec))
    for section, side in (("body", "response"), ("requestBody", "request"), ("responseBody", "response")):
        spec = m.get(section)
        if spec is None:
            continue
        plain = {k: v for k, v in spec.items() if k in ("equals", "contains", "regex")}
        if plain:
            tests += [x.body(side) != "", _text_test(x.body(side), plain)]
        if "jsonpath" in spec:
            tests += _json_tests(x.json(side), spec["jsonpath"])
    return _all(tests)


def value(spec, rule: dict, x: Exchange = Exchange()) -> Column:
    """An extractor's trimmed text; null for a blank one."""
    req, rsp = F.col(x.request), F.col(x.response)
    if isinstance(spec, str):
        text = spec.strip()
        prefixes = {"path.": "path", "header.": "header", "response.header.": "responseHeader", "cookie.": "cookie", "query.": "query"}
        kind = next((k for k in prefixes if text.startswith(k)), None)
        spec = {prefixes[kind]: text[len(kind) :]} if kind else {"literal": text}
    if "literal" in spec:
        out = F.lit(str(spec["literal"]))
    elif "path" in spec:
        pattern = java_regex(((rule.get("match") or {}).get("path") or {}).get("regex", ""))
        group = _group(pattern, spec["path"]) if pattern else None
        out = F.lit(None).cast("string") if group is None else F.regexp_extract(req["path"], rf"\A(?:{pattern})\z", group)
    elif "header" in spec:
        out = first_value(req["headers"], spec["header"].lower())
    elif "responseHeader" in spec:
        out = first_value(rsp["headers"], spec["responseHeader"].lower())
    elif "cookie" in spec:
        out = F.try_element_at(req["cookies"], F.lit(spec["cookie"].lower()))
    elif "query" in spec:
        out = F.try_element_at(req["query"], F.lit(spec["query"].lower()))
    elif "jsonpath" in spec:
        out = F.try_variant_get(x.json("request" if spec.get("target") == "request" else "response"), json_path(spec["jsonpath"]), "string")
    else:
        raise ValueError(f"unsupported extractor: {sorted(spec)}")
    return F.nullif(trimmed(out), F.lit(""))


def evaluate(exchanges: DataFrame, rules: dict, x: Exchange = Exchange()) -> DataFrame:
    """A row for each exchange and matching rule: one scan for all rules, in the rules' order.

    Adds ``rule_id, rule_description, event_type, user_id, attributes``; extracted attributes go over an
    event's, those over the defaults.
    """
    found = []
    for rule in rules["rules"]:
        event, extract = rule.get("event") or {}, rule.get("extract") or {}
        entries = [(k, F.lit(v)) for k, v in rules["defaults"].items()] + [(k, F.lit(str(v))) for k, v in (event.get("attributes") or {}).items()]
        entries = list(dict(entries).items())
        extra = [(k, value(s, rule, x)) for k, s in (extract.get("extra") or {}).items()]
        names = dict(entries) | {k: F.coalesce(v, dict(entries)[k]) if k in dict(entries) else v for k, v in extra}
        attributes = F.map_filter(F.create_map(*(c for k, v in names.items() for c in (F.lit(k), v))), lambda _, v: v.isNotNull()) if names else F.create_map().cast("map<string,string>")
        user = value(extract["user_id"], rule, x) if extract.get("user_id") else F.lit(None).cast("string")
        row = F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("description") or "").alias("rule_description"), F.lit(event.get("type") or rule["id"]).alias("event_type"), user.alias("user_id"), attributes.alias("attributes"))
        found.append(F.when(match(rule, x), row))
    prepared = prepare_bodies(exchanges, x)
    if not found:
        return prepared.where(F.lit(False))
    hit = prepared.select("*", F.explode(F.array_compact(F.array(*found))).alias("_hit"))
    return hit.select(*exchanges.columns, "_hit.*")


def session(x: Exchange = Exchange(), client_ip: Column | None = None, user_id: Column | None = None) -> tuple[Column, Column]:
    """Session id and whether it is authenticated.

    A session cookie, one that the response sets, or a session header is trusted; else the id is derived
    from the client's address, user agent and the quarter of an hour.
    """
    req, rsp = F.col(x.request), F.col(x.response)
    set_cookies = F.coalesce(F.try_element_at(rsp["headers"], F.lit("set-cookie")), F.array().cast("array<string>"))

    def set_by_response(name: str) -> Column:
        """The first value that isn't blank, of all headers that set the cookie."""
        parts = F.transform(set_cookies, lambda c: F.struct(F.lower(trimmed(F.substring_index(c, "=", 1))).alias("name"), trimmed(F.substring_index(F.substring(c, F.locate("=", c) + 1, F.length(c)), ";", 1)).alias("value"), (F.locate("=", c) > 1).alias("is_one")))
        return F.get(F.filter(parts, lambda p: p["is_one"] & (p["name"] == name) & (p["value"] != "")), 0)["value"]

    names = ("jsessionid", "smsessionid")
    blank = lambda c: F.nullif(trimmed(c), F.lit(""))
    trusted = F.coalesce(*(blank(F.try_element_at(req["cookies"], F.lit(n))) for n in names), *(blank(set_by_response(n)) for n in names), *(blank(first_value(req["headers"], n)) for n in names))
    derived = derived_session(F.coalesce(trimmed(client_ip if client_ip is not None else F.col("client.ip")), F.lit("")), F.coalesce(first_value(req["headers"], "user-agent"), F.lit("")), F.col("ts_us"))
    known = trusted.isNotNull() | (user_id.isNotNull() if user_id is not None else F.lit(False))
    return F.coalesce(trusted, derived), F.when(known, "AUTHENTICATED").otherwise("UNAUTHENTICATED")


def derived_session(ip: Column, agent: Column, ts_us: Column) -> Column:
    key = F.concat_ws("|", ip, agent, F.when(ts_us > 0, F.floor(ts_us / SESSION_BUCKET_US)).otherwise(0).cast("string"))
    return F.concat(F.lit("DERIVED-"), F.upper(F.substring(F.sha2(key, 256), 1, 24)))


def user_events(matches: DataFrame, x: Exchange = Exchange(), keep: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Events of matches, with the columns ``keep``: time, session, app and source from the attributes, trace and request ids from headers.

    A blank or missing app or source is that of ``defaults``, the rules' own.
    """
    req = F.col(x.request)
    parts = F.split(first_value(req["headers"], "traceparent"), "-")
    trace = F.coalesce(F.when(F.length(F.get(parts, 1)) == 32, F.get(parts, 1)), first_value(req["headers"], "x-b3-traceid"), first_value(req["headers"], "x-trace-id"))
    sid, state = session(x, user_id=F.col("user_id"))
    named = lambda key: F.coalesce(F.when(F.rlike(F.try_element_at("attributes", F.lit(key)), F.lit(r"\S")), F.try_element_at("attributes", F.lit(key))), F.lit((defaults or {}).get(key, "")))
    return matches.select(
        *keep,
        F.timestamp_micros(F.coalesce("rsp_ts_us", "ts_us")).alias("ts"),
        "event_type",
        "rule_id",
        "rule_description",
        sid.alias("session_id"),
        state.alias("auth_state"),
        "user_id",
        F.struct(req["method"].alias("method"), req["path"].alias("path"), F.col(f"{x.response}.status").alias("status"), F.floor(F.col("latency_us") / 1000).alias("latency_ms")).alias("http"),
        F.map_filter("attributes", lambda k, _: ~k.isin("app", "source")).alias("attributes"),
        named("source").alias("source"),
        named("app").alias("app"),
        trace.alias("trace_id"),
        F.coalesce(first_value(req["headers"], "x-request-id"), first_value(req["headers"], "request-id")).alias("request_id"),
    )


def attributes_text(attributes: Column) -> Column:
    """``[k=v;...]`` by key; null without attributes."""
    entries = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.when(F.size(entries) > 0, F.concat(F.lit("["), F.array_join(entries, ";"), F.lit("]")))


def joined_line(title: str, parts: dict[str, Column]) -> Column:
    """``title k=v, ...``; parts without a value are left out."""
    return F.concat(F.lit(f"{title} "), F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items())))


def log_line(events: DataFrame) -> DataFrame:
    """``line``: a user event as text."""
    blank = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    parts = {"type": F.col("event_type"), "rule": F.col("rule_id"), "ruleDesc": blank("rule_description"), "session": F.col("session_id"), "auth": F.col("auth_state"), "user": F.col("user_id"), "source": F.col("source"), "app": F.col("app")}
    parts |= {"method": F.col("http.method"), "path": F.col("http.path"), "status": F.col("http.status"), "latencyMs": F.col("http.latency_ms"), "traceId": F.col("trace_id"), "requestId": F.col("request_id"), "attributes": attributes_text(F.col("attributes"))}
    return events.select(joined_line("user.event", parts).alias("line"))


def extract_session(headers: Column, patterns: list[str], cookie_names: list[str]) -> Column:
    """``HDR:`` and the last group of the first pattern that finds itself in a header line, else ``SID:`` and a session cookie's value."""
    lines = F.flatten(F.transform(F.map_entries(headers), lambda e: F.transform(e["value"], lambda v: F.concat_ws(": ", e["key"], v))))
    found = [F.get(F.filter(F.transform(lines, _last_group(p)), lambda v: v.isNotNull()), 0) for p in patterns]
    cookies = F.split(F.coalesce(first_value(headers, "cookie"), F.lit("")), ";")
    return F.coalesce(*(F.concat(F.lit("HDR:"), f) for f in found), F.concat(F.lit("SID:"), F.get(_named_values(cookies, cookie_names), 0)))


def extract_set_session(set_cookies: Column, cookie_names: list[str]) -> Column:
    """``SID:`` and the value of the first session cookie that a response sets."""
    return F.concat(F.lit("SID:"), F.get(_named_values(F.transform(set_cookies, lambda c: F.substring_index(c, ";", 1)), cookie_names), 0))


def _last_group(pattern: str):
    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups
    return lambda line: F.when(F.rlike(line, F.lit(f"(?i){pattern}")), F.regexp_extract(line, f"(?i){pattern}", groups))


def _named_values(parts: Column, names: list[str]) -> Column:
    own = F.filter(parts, lambda p: (F.locate("=", p) > 1) & F.lower(trimmed(F.substring_index(p, "=", 1))).isin(*names))
    return F.transform(own, lambda p: trimmed(F.substring(p, F.locate("=", p) + 1, F.length(p))))
