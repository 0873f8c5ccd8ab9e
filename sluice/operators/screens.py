"""Screen rules: the first rule whose rectangles match a screen names it; terminal events from submits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .http import let, trimmed
from .rules import attributes_text, joined_line


def load_screens(*texts: str) -> list[dict]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("screen rules in YAML need PyYAML") from e
    out, ids = [], set()
    for text in texts:
        doc = yaml.safe_load(text) or {}
        if doc.get("version") != 1:
            raise ValueError(f"unsupported version: {doc.get('version')}")
        for s in doc.get("screens") or []:
            if s["id"] in ids:
                raise ValueError(f"duplicate screen id: {s['id']}")
            ids.add(s["id"])
            out.append(s)
    return out


def rectangle(text: Column, spec: dict, rows: Column | None = None, cols: Column | None = None) -> Column:
    """``length`` characters from a row and column, both from 1, of a screen's lines, which any line end separates.

    A screen of ``rows`` and ``cols`` is padded to them, cut at its right edge, and empty beyond; without them short rows count as padded as far as needed.
    """
    p = spec["position"]
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    line = F.coalesce(F.get(lines, p["row"] - 1), F.lit(""))
    if rows is None or cols is None:
        got = F.substring(F.rpad(line, max(p["column"] + p["length"] - 1, 1), " "), p["column"], p["length"])
    else:
        inside = (rows >= p["row"]) & (cols >= p["column"])
        got = F.when(inside, F.substring(F.rpad(line, F.greatest(cols, F.length(line)), F.lit(" ")), F.lit(p["column"]), F.lit(p["length"]))).otherwise("")
    return trimmed(got) if spec.get("trim") else got


def _matches(text: Column, spec: dict, rows: Column | None, cols: Column | None) -> Column:
    got, want = rectangle(text, spec, rows, cols), spec["equals"].strip() if spec.get("trim") else spec["equals"]
    return F.lower(got) == want.lower() if spec.get("ignoreCase") else got == want


def first_match(screens: DataFrame, rules: list[dict], text_col: str = "plain_text", rows: Column | None = None, cols: Column | None = None) -> DataFrame:
    """Adds ``screen``: id, description, label and user_id of the first rule that matches, null if none does; ``rows`` and ``cols`` as in ``rectangle``."""
    text = F.col(text_col)
    found = []
    for r in rules:
        test = F.lit(True)
        for spec in r["match"]:
            test = test & _matches(text, spec, rows, cols)
        part = lambda key: F.nullif(rectangle(text, r[key], rows, cols), F.lit("")) if r.get(key) else F.lit(None).cast("string")  # noqa: E731, B023
        found.append(F.when(test, F.struct(F.lit(r["id"]).alias("id"), F.lit(r.get("description") or "").alias("description"), part("label").alias("label"), part("userId").alias("user_id"))))
    return screens.select("*", F.coalesce(*found, F.lit(None)).alias("screen"))


def safe_key(key: Column) -> Column:
    """Lower-case letters and digits of any script, other runs as one underscore, 64 characters at most; null if nothing is left."""
    lower = F.lower(F.translate(trimmed(key), "\u0130\u03a3", "i\u03c3"))  # character by character: these two depend on what is around them
    runs = F.regexp_replace(lower, r"(?:[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])+", "_")
    return F.nullif(F.regexp_replace(F.substring(F.regexp_replace(runs, "^_", ""), 1, 64), "_$", ""), F.lit(""))


def safe_value(value: Column) -> Column:
    """Trimmed, control characters as spaces; null is empty."""
    return F.regexp_replace(trimmed(F.coalesce(value, F.lit(""))), r"[\x00-\x1f\x7f-\x9f]", " ")


def _filled(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def operator_id(rule_user: Column, inputs: Column, label: Column) -> Column:
    """The rule's user, else the input named like the label, as it is or sanitised (the last of a name, if it isn't blank), else the first input by name that isn't blank."""
    entries = F.array_sort(F.map_entries(inputs))
    some = F.filter(entries, lambda e: trimmed(e["value"]) != "")
    same = lambda of: F.filter(of, lambda e: safe_key(e["key"]) == safe_key(label))
    last = _filled(safe_value(F.try_element_at(same(F.map_entries(inputs)), F.lit(-1))["value"]))
    pick = lambda a: _filled(F.get(a, 0)["value"])
    return F.coalesce(_filled(rule_user), _filled(F.try_element_at(inputs, label)), last, pick(same(some)), pick(some))


def terminal_attributes(screen: Column, aid: Column, inputs: Column, name: Column, digest: Column, rows: Column, cols: Column) -> Column:
    """Attributes of a terminal event: the screen's, the key's and each input's, the last of inputs whose names become alike.

    Blank descriptions, labels, names and hashes are left out, and inputs whose names hold no letter or digit.
    """
    fixed = F.create_map(F.lit("screen.id"), screen["id"], F.lit("screen.description"), _filled(screen["description"]), F.lit("screen.label"), _filled(screen["label"]), F.lit("screen.name"), _filled(name), F.lit("screen.hash"), _filled(digest), F.lit("screen.rows"), rows.cast("string"), F.lit("screen.cols"), cols.cast("string"), F.lit("tn3270.aid"), aid)
    named = F.filter(F.transform(F.map_entries(inputs), lambda e: F.struct(F.concat(F.lit("input."), safe_key(e["key"])).alias("k"), safe_value(e["value"]).alias("v"))), lambda e: e["k"].isNotNull())
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["k"] == e["k"]))
    typed = let(named, lambda es: F.map_from_entries(last(es)))
    return F.map_filter(F.map_concat(fixed, typed), lambda _, v: v.isNotNull())


def log_line(events: DataFrame, *more: str) -> DataFrame:
    """``line``, and columns ``more``: a terminal event as text."""
    blank = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    parts = {"timestamp": F.col("ts"), "type": F.col("event_type"), "terminal": F.col("terminal_id"), "session": F.col("session_id"), "source": F.col("source"), "app": F.col("app"), "operator": blank("operator_id"), "traceId": blank("trace_id"), "attributes": attributes_text(F.col("attributes"))}
    return events.select(*more, joined_line("terminal.event", parts).alias("line"))


def terminal_user_events(events: DataFrame, rules: list[dict], app: str = "tn3270", source: str = "tn3270", keep: tuple[str, ...] = ()) -> DataFrame:
    """Submits, with the columns ``keep``, joined to their session's latest screen, as terminal events: screen rule, operator and attributes."""
    from .terminal import last_screen

    return published(last_screen(events, cols=("rows", "cols", "plain_text", "screen_hash", "screen_name")), rules, app, source, keep)


def published(submits: DataFrame, rules: list[dict], app: str = "tn3270", source: str = "tn3270", keep: tuple[str, ...] = ()) -> DataFrame:
    """Submits with their ``screen`` as terminal events, of a batch or a stream."""
    seen = submits.withColumn("_shown", F.col("screen")).drop("screen")
    m = first_match(seen.withColumn("_text", F.col("_shown.plain_text")), rules, "_text", F.col("_shown.rows"), F.col("_shown.cols"))
    inputs = F.coalesce("inputs", F.create_map().cast("map<string,string>"))
    return m.select(
        *keep,
        F.timestamp_micros("ts_us").alias("ts"),
        F.col("session_id").alias("terminal_id"),
        "session_id",
        F.lit("terminal.submit").alias("event_type"),
        operator_id(F.col("screen.user_id"), inputs, F.col("screen.label")).alias("operator_id"),
        F.lit(source).alias("source"),
        F.lit(app).alias("app"),
        terminal_attributes(F.col("screen"), F.col("aid"), inputs, F.col("_shown.screen_name"), F.col("_shown.screen_hash"), F.col("_shown.rows"), F.col("_shown.cols")).alias("attributes"),
        F.lit(None).cast("string").alias("trace_id"),
    )
