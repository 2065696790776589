"""Reading the groups of a partition that Spark has sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal first `keys` columns, cut after `most` rows if that is given."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pandas().to_numpy(dtype=object) for k in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        changed[0] = last is not None and tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        at = 0
        for end in [*np.flatnonzero(changed), batch.num_rows]:
            if end > at:
                held.append(batch.slice(at, end - at))
            if end < batch.num_rows or (end == 0 and changed[0]):
                if held:
                    yield from _cut(held, most)
                held = []
            at = int(end)
    if held:
        yield from _cut(held, most)


def _cut(held: list[pa.RecordBatch], most: int | None) -> Iterator[pa.Table]:
    whole = pa.Table.from_batches(held)
    for at in range(0, whole.num_rows, most or whole.num_rows):
        yield whole.slice(at, most or whole.num_rows)
