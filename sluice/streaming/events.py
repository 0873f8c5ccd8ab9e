"""User events of a stream of HTTP pairs, by rules that may change while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import http, rules
from ..sources.config import Watched


def event_stream(pairs: DataFrame, watched: Watched, write: Callable[[DataFrame, int], None], keep: tuple[str, ...] = ()) -> DataStreamWriter:
    """Each batch's events go to ``write`` with the batch's number; rules are constants of its plan, and those that ``watched`` holds when it begins.

    ``watched`` loads rules (``Watched(paths, rules.load_rule_files)``); files that can't be read or that hold an error leave the last good ones in force.
    """

    def one(batch: DataFrame, number: int) -> None:
        loaded = watched()
        matched = rules.evaluate(http.exchanges(batch), loaded)
        write(rules.user_events(matched, keep=keep, defaults=loaded["defaults"]), number)

    return pairs.writeStream.foreachBatch(one)
