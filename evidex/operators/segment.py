"""Several values packed in one field: expectation-maximisation segmentation.

Values have a frequency over the whole column. A text is a lattice whose nodes are the places
between separators and whose edges are candidate values; quoted spans are single edges, and so are
the members of a bracketed list by the list's own separator. Expectation-maximisation learns the
frequencies, the Viterbi path of the lattice is the split. A separator inside an unquoted value
survives only where the joined value is known as one value (from quotes or lists elsewhere in the
column) and is likelier than its parts.

The frequencies are a table that is joined by value, of any size. A bit map of the known joined
values, of fixed size, tells the texts that may have two readings from those that have one; what it
lets through by chance the join throws out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import Memo, batches
from evidex.session import cut

# Separators, quote pairs, brackets and list marks.
SEPARATORS = ",，;；、|｜/／\t\n\r\v\f  "
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "＂": "＂"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "<": ">", "《": "》", "「": "」"}
_SEP = re.compile(rf"[{re.escape(SEPARATORS)}]|\s{{2,}}")
_SIMPLE = re.compile(r"""["'“”‘’「」『』＂()（）\[\]【】{}<>《》\d•·●▪◦○■□◆*\-–—+①-⑳]""")
_NUMBER = re.compile(r"\s*[(（\[]?(\d{1,3})(?:[)）\]]|[.．、:：](?!\d))\s*|\s*([①-⑳])\s*")
_NEXT = re.compile(r"\s+(\d{1,3})[)）.．、:：](?!\d)\s*")
_BULLET = re.compile(r"\s*(?:[•·●▪◦○■□◆]+|[*\-–—+](?=\s|[^\d\s*\-–—+]))\s*")
#: Bits of the map of known values: 2 MB, whatever the size of the column.
_BITS = 24
#: Values that one task counts before it passes its partial sums on.
HELD = 50_000


def _strip(item: str) -> str:
    """Without the whitespace, quotes and brackets that stand around the value."""
    while True:
        item = item.strip().strip("\u200b\ufeff")
        if len(item) >= 2 and (QUOTES.get(item[0]) == item[-1] or (BRACKETS.get(item[0]) == item[-1] and _closes(item))):
            item = item[1:-1]
            continue
        bare = item.strip("\"“”＂")
        if bare == item:
            return item
        item = bare


def _closes(item: str) -> bool:
    """Whether the bracket at the start closes only at the end."""
    opening, closing, depth = item[0], BRACKETS[item[0]], 0
    for i, c in enumerate(item):
        depth += (c == opening) - (c == closing)
        if depth == 0:
            return i == len(item) - 1
    return False


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """The quoted span that opens at a place, doubled or escaped quotes read as one, and its end."""
    closing, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "\\\"'“”‘’":
            out.append(text[i + 1])
            i += 2
        elif c == closing:
            if i + 1 < len(text) and text[i + 1] == closing and closing == text[at]:
                out.append(c)
                i += 2
                continue
            rest = text[i + 1 : i + 3]
            if not rest.strip() or _SEP.match(text, i + 1) or rest[0] in ")）]】}" or rest[0].isspace() and rest[1:2] in SEPARATORS:
                return "".join(out), i + 1
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return None


Piece = tuple[str, bool, str]  # value, atomic, separator text that stood before it


def scan(text: str) -> list[Piece]:
    """The pieces between separators in order, quoted spans whole, marks and wrappings removed."""
    if not _SIMPLE.search(text):
        out, before = [], ""
        at = 0
        for m in _SEP.finditer(text):
            if item := text[at : m.start()].strip():
                out.append((item, False, before))
                before = ""
            before += m[0]
            at = m.end()
        if item := text[at:].strip():
            out.append((item, False, before))
        return out
    body, inner = text.strip(), None
    if len(body) >= 2 and body[0] in "[【" and BRACKETS[body[0]] == body[-1] and _closes(body):
        body = body[1:-1]
        inner = _own_separator(body)
    out, before, at, number = [], "", 0, 0
    while at < len(body):
        start = at
        m = _NUMBER.match(body, at)
        if m and (int(m[1]) if m[1] else ord(m[2]) - 0x245F) == number + 1 and (number or not out):
            number += 1
            at = m.end()
        elif m := _BULLET.match(body, at):
            at = m.end()
        while at < len(body) and body[at].isspace() and not _SEP.match(body, at):
            at += 1
        span = _quoted(body, at) if at < len(body) and body[at] in QUOTES else None
        values: list[tuple[str, bool]] = []
        if span:
            value, end = span
            m = _SEP.search(body, end)
            stop = m.start() if m else len(body)
            rest = body[end:stop].strip()
            values.append((value.strip() if not rest.strip(")）]】}") else (value + body[end:stop]).strip(), True))
        else:
            m = (inner or _SEP).search(body, at)
            stop = m.start() if m else len(body)
            while number and (step := _NEXT.search(body, at, stop)):
                # The next number of a numbered run begins the next value without a separator.
                if int(step[1]) != number + 1:
                    break
                values.append((_strip(body[at : step.start()]), False))
                number += 1
                at = step.end()
            values.append((_strip(body[at:stop]), inner is not None))
        for value, atomic in values:
            if value:
                out.append((value, atomic, before))
                before = ""
        if m:
            before += m[0]
            at = m.end()
        else:
            at = len(body)
        if at == start:
            at += 1
    return out


def _own_separator(body: str) -> re.Pattern | None:
    """The separator between the members of a bracketed list; None without any.

    It is the first one outside quotes; a slash or white space, which stand in values too, only without another.
    """
    at, slash = 0, None
    while at < len(body):
        if body[at] in QUOTES and (span := _quoted(body, at)):
            at = span[1]
        elif m := _SEP.match(body, at):
            sign = m[0].strip()
            if sign and sign not in "/／":
                return re.compile(re.escape(sign))
            slash = slash or (re.compile(re.escape(sign)) if sign else _SEP)
            at = m.end()
        else:
            at += 1
    return slash


def canonical(value: str) -> tuple[str, str, int]:
    """A value with separators as the join of its parts, that join's first two parts, and the number of parts."""
    joined = head = ""
    at = n = 0
    for m in [*_SEP.finditer(value), None]:
        part = value[at : m.start() if m else len(value)].strip()
        if part or not m:
            joined += part
            n += 1
            if n == 2:
                head = joined
        if m:
            joined += m[0]
            at = m.end()
    return joined, head or joined, n


class Known(NamedTuple):
    """Bit maps of the joined values of the column and of their first two parts, and the most parts of one."""

    values: bytes
    heads: bytes
    most: int


def _bit(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> (32 - _BITS)


def _in(bits: bytes, text: str) -> bool:
    at = _bit(text)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def joined_edges(pieces: Sequence[Piece], known: Known | None) -> list[tuple[int, int, str]]:
    """Candidates over two or more unquoted pieces in a row that may be known as one value."""
    out = []
    if known is None:
        return out
    for i in range(len(pieces) - 1):
        joined = pieces[i][0]
        for j in range(i, min(i + known.most, len(pieces))):
            if pieces[j][1]:
                break
            if j > i:
                joined += pieces[j][2] + pieces[j][0]
                if j == i + 1 and not _in(known.heads, joined):
                    break
                if _in(known.values, joined):
                    out.append((i, j + 1, joined))
    return out


Edge = tuple[int, int, str, float]  # from place, to place, value, its frequency


def _log(n: float, total: float, value: str) -> float:
    return math.log(n / total) if n > 0 else -math.log(total) - 1.5 * len(value)


def viterbi(edges: Sequence[Edge], total: float) -> list[str]:
    """The likeliest sequence of values; of equals that of the shorter ones."""
    n = max(e[1] for e in edges)
    into: list[list[Edge]] = [[] for _ in range(n + 1)]
    for e in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        into[e[1]].append(e)
    best, back = [0.0] + [-math.inf] * n, [("", 0)] * (n + 1)
    for j in range(1, n + 1):
        for i, _, value, freq in into[j]:
            score = best[i] + _log(freq, total, value)
            if score > best[j]:
                best[j], back[j] = score, (value, i)
    out, at = [], n
    while at:
        value, at = back[at]
        out.append(value)
    return out[::-1]


def expected_counts(edges: Sequence[Edge], total: float) -> dict[str, float]:
    """Forward-backward expectation of each value's count in one lattice, worked out in logarithms."""
    n = max(e[1] for e in edges)
    weight = [_log(freq, total, value) for _, _, value, freq in edges]
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for k in sorted(range(len(edges)), key=lambda k: edges[k][1]):
        i, j, _, _ = edges[k]
        forward[j] = np.logaddexp(forward[j], forward[i] + weight[k])
    for k in sorted(range(len(edges)), key=lambda k: -edges[k][0]):
        i, j, _, _ = edges[k]
        backward[i] = np.logaddexp(backward[i], backward[j] + weight[k])
    out: dict[str, float] = {}
    for (i, j, value, _), w in zip(edges, weight):
        out[value] = out.get(value, 0.0) + math.exp(forward[i] + w + backward[j] - forward[n])
    return out


def _texts(df: DataFrame, fields: Mapping[str, str], record_id: str) -> DataFrame:
    """Long table (field, record_id, text) of the non-null fields, by one pass over df."""
    packed = F.filter(
        F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).cast("string").alias("text")) for name, column in fields.items()]),
        lambda x: x["text"].isNotNull(),
    )
    return df.select(F.col(record_id).cast("bigint").alias("record_id"), F.explode(packed).alias("x")).select("x.field", "record_id", "x.text")


def _count_values(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, n, joined): each value's count, and how often it stood as one value with a separator inside."""
    plain: Counter = Counter()
    joined: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = [*plain, *joined]
        sums = [*plain.values(), *joined.values()]
        held = [0.0] * len(plain) + [float(x) for x in joined.values()]
        plain.clear()
        joined.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.float64()), pa.array(held, pa.float64())], ["value", "n", "joined"])

    for batch in batches(rows):
        for text in batch.column(0).to_pylist():
            for value, atomic, _ in scan(text):
                if atomic and _SEP.search(value):
                    joined[canonical(value)[0]] += 1
                else:
                    plain[value] += 1
        if len(plain) + len(joined) > HELD:
            yield out()
    yield out()


def value_frequencies(texts: DataFrame) -> DataFrame:
    """(value, n, joined) over every text of the column: the frequencies that the maximisation starts from."""
    counts = texts.select("text").mapInArrow(_count_values, "value string, n double, joined double")
    return counts.groupBy("value").agg(F.sum("n").alias("n"), F.sum("joined").alias("joined"))


def known_values(frequencies: DataFrame) -> tuple[Known | None, float]:
    """Bit maps of the joined values, None without any, and the number of all values.

    What reaches the driver is of fixed size: words of the maps and two numbers.
    """

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [canonical(v) for v in batch.column(0).to_pylist()]
            places = np.array([(kind << _BITS) | _bit(text) for joined, head, _ in found for kind, text in ((0, joined), (1, head))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(np.int64(1) << (places & 31)), pa.array(np.repeat([n for _, _, n in found], 2), pa.int32())], ["word", "bits", "parts"])

    total = frequencies.agg(F.sum("n")).first()[0] or 1.0
    words = frequencies.where("joined > 0").select("value").mapInArrow(bits, "word bigint, bits bigint, parts int")
    held = words.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.max("parts").alias("parts")).toArrow()
    if not held.num_rows:
        return None, total
    maps = np.zeros(1 << (_BITS - 4), "<u4")
    maps[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    raw, half = maps.tobytes(), 1 << (_BITS - 3)
    return Known(raw[:half], raw[half:], max(2, int(np.max(held.column("parts").to_numpy())))), total


def resolve(hard: DataFrame, frequencies: DataFrame, known: Known, total: float, iterations: int = 3) -> DataFrame:
    """(text, items) of texts that may have several readings: expectation-maximisation, then the Viterbi path.

    hard has a column text. The lattices' edges meet the frequencies by a join; a candidate that the
    column doesn't know after all has no edge.
    """

    def edges_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = scan(text)
                for i, j, value in [*((i, i + 1, p[0]) for i, p in enumerate(pieces)), *joined_edges(pieces, known)]:
                    for c, x in zip(cols, (text, times, i, j, value)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], ["text", "times", "i", "j", "value"])

    def expect(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for batch in batches(rows):
            for edges, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for value, x in expected_counts([(e["i"], e["j"], e["value"], e["freq"]) for e in edges], total).items():
                    held[value] = held.get(value, 0.0) + times * x
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["value", "x"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["value", "x"])

    def path(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            best = [viterbi([(e["i"], e["j"], e["value"], e["freq"]) for e in edges], total) for edges in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.list_(pa.string()))], ["text", "items"])

    once = hard.groupBy("text").agg(F.count("*").alias("times"))
    edges = once.mapInArrow(edges_of, "text string, times bigint, i int, j int, value string")
    weighed = edges.join(frequencies, "value", "left").where((F.col("j") == F.col("i") + 1) | (F.coalesce("joined", F.lit(0.0)) > 0))
    # What a value counts in texts of one reading: the rest of its count is expected anew in every round.
    here = edges.where("j = i + 1").groupBy("value").agg(F.sum("times").alias("here"))
    weighed = cut(weighed.join(here, "value", "left").select("text", "times", "i", "j", "value", F.greatest(F.coalesce("n", F.lit(0.0)) - F.coalesce("here", F.lit(0)), F.lit(0.0)).alias("base"), F.coalesce("n", F.lit(0.0)).alias("freq")))

    def lattices(frame: DataFrame) -> DataFrame:
        return frame.groupBy("text", "times").agg(F.collect_list(F.struct("i", "j", "value", "freq")).alias("edges")).select("text", "edges", "times")

    for _ in range(iterations):
        expected = cut(lattices(weighed).mapInArrow(expect, "value string, x double").groupBy("value").agg(F.sum("x").alias("x")))
        weighed = weighed.join(expected, "value", "left").select("text", "times", "i", "j", "value", "base", (F.col("base") + F.coalesce("x", F.lit(0.0))).alias("freq"))
    return lattices(weighed).mapInArrow(path, "text string, items array<string>")


def unpack_texts(texts: DataFrame) -> DataFrame:
    """(field, record_id, pos, item) of a long table (field, record_id, text)."""
    frequencies = cut(value_frequencies(texts))
    known, total = known_values(frequencies)

    def several(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            hit = [k for k, text in enumerate(batch.column(2).to_pylist()) if joined_edges(scan(text), known)]
            if hit:
                yield batch.take(pa.array(hit))

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The path of a lattice without joined edges is the only one; texts with some are resolved apart.
        def only(text: str) -> list[str]:
            pieces = scan(text)
            return [] if joined_edges(pieces, known) else [p[0] for p in pieces]

        memo = Memo(only)
        for batch in batches(rows):
            found = [memo[t] for t in batch.column(2).to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            at = np.repeat(np.arange(len(found)), size)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + 1
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array([v for one in found for v in one], pa.string())],
                ["field", "record_id", "pos", "item"],
            )

    out = texts.mapInArrow(split, "field string, record_id bigint, pos int, item string")
    if known is None:
        return out
    hard = cut(texts.mapInArrow(several, "field string, record_id bigint, text string"))
    if hard.isEmpty():
        return out
    resolved = resolve(hard, frequencies, known, total)
    again = hard.join(resolved, "text").select("field", "record_id", F.posexplode("items").alias("at", "item"))
    return out.unionByName(again.select("field", "record_id", (F.col("at") + 1).alias("pos"), "item"))


def unpack(df: DataFrame, fields: Mapping[str, str], record_id: str) -> DataFrame:
    """One row (field, record_id, pos, item) for each value of each field named in fields.

    fields maps output names to columns. Null, empty and blank fields and those of separators only
    give no row; repeated values keep their places. A bracketed list's unquoted members are parted by
    the list's first separator only. The frequencies are learned from these texts.
    """
    return unpack_texts(_texts(df, fields, record_id))


def unpack_all(parts: list[tuple[DataFrame, Mapping[str, str], str]]) -> DataFrame:
    """unpack over several tables with one model for all their fields."""
    return unpack_texts(reduce(DataFrame.unionByName, [_texts(df, fields, key) for df, fields, key in parts]))
