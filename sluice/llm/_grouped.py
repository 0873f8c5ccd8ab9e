"""Streaming over sorted Arrow batches, one group of equal keys at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each run of equal ``keys`` (64-bit integers without nulls), which may cross batches; only one run is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        begins = np.flatnonzero(change)
        rows = pa.Table.from_batches([batch])
        for i, a in enumerate(begins):
            b = begins[i + 1] if i + 1 < len(begins) else batch.num_rows
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
