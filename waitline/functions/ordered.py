"""Reading sorted partitions in order, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[int, int, tuple]]:
    """(start, stop, key) of each stretch of equal keys in a batch sorted by them."""
    n = batch.num_rows
    if not n:
        return
    changed = np.zeros(n - 1, dtype=bool)
    for k in keys:
        column = batch.column(k)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changed |= pc.fill_null(differs, False).to_numpy(zero_copy_only=False)
        changed |= pc.xor(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    cuts = np.concatenate(([0], np.flatnonzero(changed) + 1, [n]))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield start, stop, tuple(batch.column(k)[start].as_py() for k in keys)
