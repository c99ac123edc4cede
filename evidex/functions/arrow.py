"""Helpers for mapInArrow stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIMIT = 200_000


class Memo(dict):
    """Results by text for one Python worker; emptied when full, so memory stays bounded."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= _LIMIT:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the batches that hold rows."""
    for batch in rows:
        if batch.num_rows:
            yield batch


def slices(rows: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column has about most_bytes in each; a longer text has a batch of its own."""
    for batch in batches(rows):
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end
