"""Rows of a task that are sorted by their group, as Arrow tables that end where a group ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the keys, cut only between groups, with the first row of each group."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        firsts = firsts_of(held, keys)
        if len(firsts) > 1:
            yield held.slice(0, firsts[-1]).combine_chunks(), firsts[:-1]
            held = held.slice(firsts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), firsts_of(held, keys)


def firsts_of(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    changed = np.zeros(rows.num_rows, bool)
    changed[:1] = True
    for key in keys:
        values = rows.column(key).to_pandas().to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)
