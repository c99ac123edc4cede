"""Evaluation texts leaking into training text.

Both sides are reduced to letters and digits. All n-grams of the test items go into two bit maps of
fixed size; one scan of the corpus keeps the documents with n-grams that pass, and joins on the
n-grams' hashes make that exact, whatever the number of items. All n-grams that occur in the corpus
are seeds, so each document that shares one with an item is found, an edited copy as well as a
literal one. Where only literal leaks are wanted, the rarest n-gram of each stretch of an item as long
as the shortest passage is enough (winnowing by rarity over the whole corpus): a leaked passage always
holds one. Each seeded pair of document and item is aligned by Smith-Waterman around its seeds, which
scores edited copies, and the longest exact run decides on literal leaks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.arrow import batches, slices
from evidex.functions.codepoints import from_codepoints, gather, row_of, to_codepoints
from evidex.session import cut

#: Letters and digits of the shortest passage, and of a seed.
PASSAGE, SEED = 50, 20
#: Most bits of a map, and n-grams that one scan of the corpus searches for: beyond them there are several scans.
MOST_BITS, SCAN_GRAMS = 27, 16_000_000
#: Cells of the windows that are aligned together.
ALIGNED = 24_000
#: No letter or digit has a code point from here on: only tags, selectors and private use.
LETTERS_END = 0x40000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _fold() -> np.ndarray:
    """Lower-case, half-width form of each letter and digit; 0 for everything else."""
    table = np.zeros(LETTERS_END, np.uint32)
    for cp in range(LETTERS_END):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if 0xFF00 <= cp <= 0xFFEF:
            c = unicodedata.normalize("NFKC", c)
        if len(c) == 1 and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"):
            low = c.lower()
            table[cp] = ord(low if len(low) == 1 else c)
    return table


def bare(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and digits of each row, and their offsets."""
    cps, offsets = to_codepoints(column)
    folded = gather(_fold(), cps, 0)
    keep = folded > 0
    kept = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return folded[keep], kept[offsets]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(text: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams, by doubling: the hash of a span is that of its halves."""
    if len(text) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = {1: _mix((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))}
        scale = {1: _BASE}
        size = 1
        while size * 2 <= n:
            h = power[size]
            power[size * 2] = h[:-size] * scale[size] + h[size:]
            scale[size * 2] = scale[size] * scale[size]
            size *= 2
        out, have = None, 0
        for size in sorted(power, reverse=True):
            if n - have >= size:
                part = power[size][have : have + len(text) - n + 1]
                out = part.copy() if out is None else out * scale[size] + part
                have += size
        return _mix(out)


def align_many(documents: list[np.ndarray], items: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the Smith-Waterman score of the best local alignment and the longest exact run.

    Pairs are padded to one size with characters that match nothing; one array pass over all of them
    is made for each character of the longest item. A gap costs `gap` a character.
    """
    width, height = max(map(len, documents), default=0), max(map(len, items), default=0)
    doc = np.full((len(documents), width), 1 << 30, np.int32)
    text = np.full((height, len(items)), -1, np.int32)
    for k, (d, i) in enumerate(zip(documents, items)):
        doc[k, : len(d)], text[: len(i), k] = d, i
    ramp = np.arange(width + 1, dtype=np.int32) * gap
    row, run = np.zeros((len(doc), width + 1), np.int32), np.zeros((len(doc), width + 1), np.int32)
    best, longest = np.zeros((len(doc), width + 1), np.int32), np.zeros((len(doc), width + 1), np.int32)
    nxt = np.zeros_like(row)
    for c in text:
        same = doc == c[:, None]
        step = row[:, :-1] + np.where(same, np.int32(match), np.int32(mismatch))
        np.maximum(step, row[:, 1:] - np.int32(gap), out=step)
        np.maximum(step, 0, out=nxt[:, 1:])
        row = nxt + ramp
        np.maximum.accumulate(row, axis=1, out=row)
        row -= ramp
        np.maximum(best, row, out=best)
        run[:, 1:] = (run[:, :-1] + 1) * same
        np.maximum(longest, run, out=longest)
    return best.max(1, initial=0), longest.max(1, initial=0)


def align(document: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """align_many of one pair."""
    best, longest = align_many([document], [item])
    return int(best[0]), int(longest[0])


class GramMaps:
    """Two packed bit maps of n-gram hashes: which n-grams of a text may be those of an item."""

    def __init__(self, bits: int, first: bytes, second: bytes) -> None:
        self.bits, self.first, self.second = bits, first, second

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes in both maps."""
        with np.errstate(over="ignore"):
            return (h >> np.uint64(64 - bits)).astype(np.int64), ((h * _BASE) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are in both maps."""
        one, two = np.frombuffer(self.first, np.uint8), np.frombuffer(self.second, np.uint8)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        maybe = np.flatnonzero(one[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        at = self.places(h[maybe], self.bits)[1]
        return maybe[(two[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0]


def _item_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, letters, n): items as their letters and digits."""
    for batch in slices(rows, 2):
        flat, offsets = bare(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), from_codepoints(flat, offsets), pa.array(np.diff(offsets).astype(np.int32))], ["item", "item_id", "letters", "n"])


def _grams_of(n: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, gram, at): the n-grams of items."""
        for batch in slices(rows, 1):
            flat, offsets = to_codepoints(batch.column(1))
            h = rolling(flat, n)
            owner = row_of(offsets)
            at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(h[at].view(np.int64)), pa.array((at - offsets[owner[at]]).astype(np.int32))], ["item", "gram", "at"])

    return run


def gram_maps(grams: DataFrame, bits: int) -> GramMaps:
    """The bit maps of the n-grams; the driver gets their words, which are of bounded number."""

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            one, two = GramMaps.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            places = np.concatenate((one, two + (1 << bits)))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(np.int64(1) << (places & 31))], ["word", "bits"])

    held = grams.select("gram").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    maps = np.zeros(1 << (bits - 4), "<u4")
    maps[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    raw, half = maps.tobytes(), 1 << (bits - 3)
    return GramMaps(bits, raw[:half], raw[half:])


def seeded_documents(documents: DataFrame, doc_id: str, text: str, maps: GramMaps, n: int) -> DataFrame:
    """(doc, doc_id, letters, hits): the documents with n-grams in the maps, by one scan of the corpus."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, 2):
            flat, offsets = bare(batch.column(2))
            h = rolling(flat, n)
            if not len(h):
                continue
            pos = maps.find(h)
            owner = row_of(offsets)
            pos = pos[owner[pos] == owner[pos + n - 1]]
            if not len(pos):
                continue
            held, size = np.unique(owner[pos], return_counts=True)
            take = pa.array(held)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            letters = from_codepoints(flat, offsets).take(take)
            hits = pa.StructArray.from_arrays([pa.array(h[pos].view(np.int64)), pa.array((pos - offsets[owner[pos]]).astype(np.int32))], ["gram", "pos"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), letters, pa.ListArray.from_arrays(pa.array(ends), hits)], ["doc", "doc_id", "letters", "hits"])

    rows = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    keyed = rows.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc bigint, doc_id bigint, letters string, hits array<struct<gram:bigint,pos:int>>")


def literal_seeds(grams: DataFrame, frequency: DataFrame, passage: int, n: int) -> DataFrame:
    """(item, gram, at): of each stretch of `passage` letters of an item the rarest n-gram, of equals the later one.

    A stretch with an n-gram that the corpus doesn't have stands nowhere and needs no seed.
    """
    window = passage - n + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            items, found, places = [], [], []
            for item, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rank = np.array([x["count"] for x in held], np.int64)
                if len(rank) < window:
                    continue
                views = np.lib.stride_tricks.sliding_window_view(rank * (len(rank) + 1) - np.arange(len(rank)), window)
                whole = np.lib.stride_tricks.sliding_window_view(rank, window).min(1) > 0
                at = np.unique((views.argmin(1) + np.arange(len(views)))[whole])
                items += [item] * len(at)
                found += [held[k]["gram"] for k in at]
                places += [held[k]["at"] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, pa.int64()), pa.array(places, pa.int32())], ["item", "gram", "at"])

    counted = grams.join(frequency, "gram", "left").select("item", F.struct("at", "gram", F.coalesce("count", F.lit(0)).alias("count")).alias("x"))
    held = counted.groupBy("item").agg(F.array_sort(F.collect_list("x")).alias("grams"))
    return held.mapInArrow(run, "item bigint, gram bigint, at int")


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, item, part): the stretches of a document in which an item's copy would lie, by its seeds."""
    for batch in batches(rows):
        out: tuple[list, ...] = ([], [], [], [])
        for doc, doc_id, letters, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            for pair in pairs:
                length, starts = pair["n"], sorted(pair["starts"])
                # Seeds at about the same place share one window; windows of one pair don't overlap much.
                slack = max(16, length // 4)
                at = 0
                while at < len(starts):
                    end = at
                    while end + 1 < len(starts) and starts[end + 1] - starts[end] <= slack:
                        end += 1
                    for column, x in zip(out, (doc, doc_id, pair["item"], letters[max(0, starts[at] - slack) : starts[end] + length + slack])):
                        column.append(x)
                    at = end + 1
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc", "doc_id", "item", "part"])


def _aligned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, item, item_id, score, longest_run) of each window and item; windows of about one size are aligned together."""
    for batch in batches(rows):
        (part, part_at), (item, item_at) = to_codepoints(batch.column(4)), to_codepoints(batch.column(5))
        widths, heights = np.diff(part_at), np.diff(item_at)
        score, longest = np.zeros(len(widths)), np.zeros(len(widths), np.int32)
        order = np.lexsort((heights, widths))[::-1]
        while len(order):
            take = max(1, min(len(order), ALIGNED // (int(widths[order[0]]) + 1)))
            now, order = order[:take], order[take:]
            best, run = align_many([part[part_at[k] : part_at[k + 1]] for k in now], [item[item_at[k] : item_at[k + 1]] for k in now])
            score[now], longest[now] = best / (2 * heights[now]), run
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score), pa.array(longest)], ["doc", "doc_id", "item", "item_id", "score", "longest_run"])


def _search(documents: DataFrame, doc_id: str, text: str, items: DataFrame, grams: DataFrame, bits: int, passage: int, n: int, edited: bool) -> DataFrame:
    found = cut(seeded_documents(documents, doc_id, text, gram_maps(grams, bits), n))
    hits = found.select("doc", F.explode("hits").alias("x")).select("doc", "x.gram", "x.pos")
    seeds = grams if edited else cut(literal_seeds(grams, hits.groupBy("gram").count(), passage, n))
    # The item's start in the document by each seed.
    starts = hits.join(seeds, "gram").groupBy("doc", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("starts"))
    pairs = starts.join(items.select("item", "n"), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "n", "starts")).alias("pairs"))
    windows = found.select("doc", "doc_id", "letters").join(pairs, "doc").mapInArrow(_windows, "doc bigint, doc_id bigint, item bigint, part string")
    both = windows.join(items.select("item", "item_id", "letters"), "item").select("doc", "doc_id", "item", "item_id", "part", "letters")
    aligned = both.mapInArrow(_aligned, "doc bigint, doc_id bigint, item bigint, item_id bigint, score double, longest_run int")
    best = aligned.groupBy("doc", "doc_id", "item", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))
    return best.select("doc_id", "item_id", "score", "longest_run")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage: int = PASSAGE, n: int = SEED, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, longest_run) for each seeded pair of a document and an item.

    score is the Smith-Waterman score by that of the whole item, 1 for a full copy; longest_run counts
    the letters and digits in a row that both share. Pairs with a run of at least n are all here;
    without edited, only those with a run of at least `passage` surely are. Null and empty texts, and
    items shorter than passage, give no row; a repeated document or item id gives a row for each of
    its texts.
    """
    if not 0 < n <= passage:
        raise ValueError("a seed can't be longer than the passage")
    spark: SparkSession = documents.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    keyed = rows.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    kept = cut(keyed.mapInArrow(_item_rows, "item bigint, item_id bigint, letters string, n int").where(F.col("n") >= passage))
    many = kept.agg(F.sum(F.col("n") - (n - 1))).first()[0] or 0
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, longest_run int")
    scans = -(-many // SCAN_GRAMS)
    bits = min(MOST_BITS, max(22, (16 * min(many, SCAN_GRAMS)).bit_length()))
    for scan in range(scans):
        own = kept if scans == 1 else kept.where(F.pmod(F.xxhash64("item"), F.lit(scans)) == scan)
        grams = own.select("item", "letters").mapInArrow(_grams_of(n), "item bigint, gram bigint, at int")
        out = out.unionByName(_search(documents, doc_id, text, own, grams, bits, passage, n, edited))
    return out
