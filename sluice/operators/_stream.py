"""Flows in order through a machine, a batch at a time: a flow's rows may cross batches, and only its machine is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

#: Rows that one batch of output holds at most.
ROWS = 1024


def by_flow(rows: DataFrame, key: str, order: list[str], machine: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows of ``key`` in ``order`` through ``machine()``: ``feed`` takes a row as a tuple, ``finish`` ends a flow; both give rows.

    Spills as a sort does, so neither a long flow nor a hot key has to fit in memory.
    """
    ship(rows.sparkSession)
    names = [c.name for c in rows.sparkSession.createDataFrame([], schema).schema]
    at = rows.columns.index(key)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or row[at] != current:
                    if now is not None:
                        out.extend(now.finish())
                    current, now = row[at], machine()
                out.extend(now.feed(row))
                if len(out) >= ROWS:
                    yield batch(out)
                    out = []
        if now is not None:
            out.extend(now.finish())
        if out:
            yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)
