"""Percentiles of very large numeric columns, by deterministic buffer collapsing.

A sketch holds, level by level, sorted buffers of `size` values that each stand for fan**level
values. When a level has `fan` buffers they collapse into one of the next level: the merged weighted
sequence is sampled at evenly spaced positions. The tree of collapses bounds the total rank error,
and each sketch carries its own bound. Sketches of partitions, days or tables merge into one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches
from evidex.session import cut

#: Values in a buffer and buffers that collapse at once; the bound is about levels / (2 * SIZE) of n.
SIZE, FAN = 1024, 8
#: Sketches of one group that one step of a merge takes.
FAN_IN = 32


class Sketch:
    """Mergeable quantile sketch with a tracked bound of its rank error."""

    def __init__(self, size: int = SIZE, fan: int = FAN) -> None:
        self.size, self.fan = size, fan
        self.n = self.error = self.phase = 0
        self.loose = np.empty(0)
        self.levels: list[list[np.ndarray]] = []
        self.low, self.high = np.inf, -np.inf

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self._fill(values)

    def _fill(self, values: np.ndarray) -> None:
        values = np.concatenate((self.loose, values)) if len(self.loose) else values
        whole = len(values) // self.size * self.size
        for at in range(0, whole, self.size):
            self._put(0, np.sort(values[at : at + self.size]))
        self.loose = values[whole:].copy()

    def _put(self, level: int, buffer: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(buffer)
        if len(self.levels[level]) == self.fan:
            merged = np.sort(np.concatenate(self.levels[level]))
            self.levels[level] = []
            # Evenly spaced positions; for an even fan the two middle offsets take turns.
            start = (self.fan - 1) // 2 if self.fan % 2 else self.fan // 2 - 1 + self.phase
            self.phase ^= 1
            self.error += (self.fan // 2) * self.fan**level
            self._put(level + 1, merged[start :: self.fan])

    def merge(self, other: Sketch) -> None:
        if other.n == 0:
            return
        self.n += other.n
        self.error += other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level, held in enumerate(other.levels):
            for buffer in held:
                self._put(level, buffer)
        self._fill(other.loose)

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Value at rank ceil(share * n) of the weighted values; exact at the ends and without collapses."""
        if self.n == 0:
            return [None] * len(shares)
        values = [self.loose, *(b for held in self.levels for b in held)]
        weights = [np.ones(len(self.loose)), *(np.full(self.size, float(self.fan**level)) for level, held in enumerate(self.levels) for _ in held)]
        flat, weight = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(flat, kind="stable")
        ranks = np.cumsum(weight[order])
        out = []
        for share in shares:
            rank = max(1, int(np.ceil(share * self.n - 1e-9)))
            if rank == 1 or share >= 1:
                out.append(self.low if rank == 1 else self.high)
            else:
                out.append(float(flat[order[min(np.searchsorted(ranks, rank), len(ranks) - 1)]]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqqqqdd", self.size, self.fan, self.n, self.error, self.phase, len(self.loose), self.low, self.high)
        counts = struct.pack(f"<q{len(self.levels)}q", len(self.levels), *map(len, self.levels))
        return head + counts + b"".join(np.asarray(b, "<f8").tobytes() for b in [self.loose, *(b for held in self.levels for b in held)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        size, fan, n, error, phase, loose, low, high = struct.unpack_from("<qqqqqqdd", data)
        out = cls(size, fan)
        out.n, out.error, out.phase, out.low, out.high = n, error, phase, low, high
        (levels,) = struct.unpack_from("<q", data, 64)
        counts = struct.unpack_from(f"<{levels}q", data, 72)
        flat = np.frombuffer(data, "<f8", -1, 72 + 8 * levels)
        out.loose, at = flat[:loose].copy(), loose
        for held in counts:
            out.levels.append([flat[at + k * size : at + (k + 1) * size] for k in range(held)])
            at += held * size
        return out


def _sketch_rows(size: int, fan: int, most_groups: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[k].to_bytes() for k in keys], pa.binary())], ["grp", "sketch"])
            held.clear()
            return batch

        for batch in batches(rows):
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            names = coded.dictionary.to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) != 0)))
            for at, end in zip(starts, [*starts[1:], len(order)]):
                name = names[codes[order[at]]]
                if name not in held:
                    held[name] = Sketch(size, fan)
                held[name].add(values[order[at:end]])
            if len(held) > most_groups:
                yield out()
        if held:
            yield out()

    return run


def _fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, bucket, sketch): one sketch for each run of equal (grp, bucket) in sorted rows, one sketch in memory at a time."""
    key, held = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([held.to_bytes()], pa.binary())], ["grp", "bucket", "sketch"])

    for batch in batches(rows):
        for grp, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            sketch = Sketch.from_bytes(data.as_py())
            if key == (grp, bucket):
                held.merge(sketch)
                continue
            if key is not None:
                yield out()
            key, held = (grp, bucket), sketch
    if key is not None:
        yield out()


def merge_sketches(sketches: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch (grp, sketch) a group from many, by a tree of as many levels as the commonest group needs.

    At each level about fan_in sketches of a group meet, chosen and ordered by their content, so that the
    result doesn't depend on the order in which tasks end. A task holds one sketch at a time.
    """
    rows = cut(sketches.select("grp", "sketch"))
    most = rows.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    buckets = [1]
    while buckets[0] * fan_in < most:
        buckets.insert(0, buckets[0] * fan_in)
    for n in buckets:
        keyed = rows.withColumn("mark", F.xxhash64("sketch")).select("grp", F.pmod("mark", F.lit(n)).alias("bucket"), "sketch", "mark")
        ordered = keyed.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "mark", "sketch").select("grp", "bucket", "sketch")
        rows = ordered.mapInArrow(_fold, "grp string, bucket bigint, sketch binary").select("grp", "sketch")
    return rows


def sketch_column(df: DataFrame, group: str, value: str, size: int = SIZE, fan: int = FAN, most_groups: int = 2000) -> DataFrame:
    """Partial sketches (grp, sketch), one a partition and group. Null and NaN values are none; a null group is a group."""
    number = F.col(value).cast("double")
    rows = df.select(F.col(group).cast("string").alias("grp"), number.alias("v")).where(number.isNotNull() & ~F.isnan(number))
    return rows.mapInArrow(_sketch_rows(size, fan, most_groups), "grp string, sketch binary")


def read_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(grp, n, rank_error, p...) of merged sketches."""
    names = [f"p{round(100 * s, 4):g}".replace(".", "_") for s in shares]
    schema = "grp string, n bigint, rank_error bigint, " + ", ".join(f"{c} double" for c in names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            read = [Sketch.from_bytes(x) for x in batch.column(1).to_pylist()]
            values = [s.quantiles(shares) for s in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.n for s in read]), pa.array([s.error for s in read]), *(pa.array([v[i] for v in values], pa.float64()) for i in range(len(shares)))],
                ["grp", "n", "rank_error", *names],
            )

    return sketches.mapInArrow(run, schema)


def group_percentiles(df: DataFrame, group: str, value: str, shares: list[float], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Percentiles of a column by group, each within rank_error ranks of the true one.

    Values are those at rank ceil(share * n). A group without values gives no row; ties, infinities
    and repeated rows count as they stand. An empty table gives an empty result.
    """
    return read_quantiles(merge_sketches(sketch_column(df, group, value, size, fan)), shares)
