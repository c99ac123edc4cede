"""Arrow text as numpy code-point arrays: one decode for a whole batch, no call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Code points below this bound have table entries; those above stand for themselves.
TABLE_SIZE = 0x30000


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the n + 1 offsets of the rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    if hi == lo:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, hi - lo, lo)
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cps, starts[offs - lo]


def from_codepoints(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The rows of a code-point array as an Arrow string array; rows where valid is False are null."""
    width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4))).astype(np.int64)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    n = len(offsets) - 1
    bitmap = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    array = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends[offsets].astype(np.int64).tobytes()), pa.py_buffer(data), bitmap)
    return array.cast(pa.string()) if len(data) < 2**31 else array


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each code point the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-code-point array within each row; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(table: np.ndarray, cps: np.ndarray, default: int | None = None) -> np.ndarray:
    """Look code points up in a table; those beyond it give default, or themselves."""
    inside = cps < len(table)
    if inside.all():
        return table[cps]
    out = table[np.where(inside, cps, 0)]
    return np.where(inside, out, cps if default is None else default).astype(table.dtype)
