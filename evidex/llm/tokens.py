"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts of usual length are encoded as they are. A long text is cut at places where the tokenizer's
pattern always ends a piece; a long run that the pattern leaves unsplit is halved like a tree. The
parts are encoded in parallel and put together from the leaves up: around each join a growing window
is encoded again until both sides agree exactly with it, which holds when the tokens next to the
window's ends encode to themselves in pairs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that is cut into parts, of a part, and bytes of a leaf of an unsplit run.
LONG, PART, LEAF = 1 << 14, 1 << 13, 1 << 9
#: Largest vocabulary file that is sent to the executors.
MOST_BYTES = 64 << 20
_ENDS = set(",.;:!?()[]{}\"'0123456789，。！？；：、（）【】《》“”…—")


@cache
def _encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


def _piece(enc: tiktoken.Encoding, data: bytes) -> list[int]:
    return enc._encode_single_piece(data)


def join(enc: tiktoken.Encoding, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """Encoding of one unsplit run from the encodings of its two parts."""
    if not left or not right:
        return left + right
    data = enc.decode_tokens_bytes

    def agree(a: int, b: int) -> bool:
        return _piece(enc, b"".join(data([a, b]))) == [a, b]

    while True:
        lo, hi = max(0, len(left) - window), min(len(right), window)
        middle = _piece(enc, b"".join(data(left[lo:] + right[:hi])))
        if (lo == 0 or agree(left[lo - 1], middle[0])) and (hi == len(right) or agree(middle[-1], right[hi])):
            return left[:lo] + middle + right[hi:]
        window *= 2


def join_all(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    """Tree concatenation of the parts of one unsplit run."""
    while len(parts) > 1:
        parts = [join(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def leaves(run: str, leaf: int = LEAF) -> list[str]:
    """Halves of halves of an unsplit run, each of at most leaf bytes."""
    if len(run) * 4 <= leaf or len(run.encode()) <= leaf or len(run) < 2:
        return [run]
    return leaves(run[: len(run) // 2], leaf) + leaves(run[len(run) // 2 :], leaf)


def _safe(text: str, i: int) -> bool:
    """Whether the pattern always ends a piece before place i, whatever surrounds it."""
    before, here = text[i - 1], text[i]
    if here == " ":
        return not before.isspace() and i + 1 < len(text) and not text[i + 1].isspace()
    if here.isspace():
        return False
    # A run of spaces would end otherwise at the end of a text, so only a lone one may stand before.
    return before.isalpha() and here in _ENDS or before in "\n\r\t" and i >= 2 and not text[i - 2].isspace()


def parts(text: str, size: int = PART, leaf: int = LEAF) -> list[tuple[int, str]]:
    """(run, part) in order: parts of run 0 stand alone, those of one run above 0 are one unsplit piece."""
    out: list[tuple[int, str]] = []
    at = run = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and not _safe(text, end):
            end += 1
            if end - at > 2 * size:
                break
        if end == len(text) or _safe(text, end):
            out.append((0, text[at:end]))
            at = end
            continue
        # No safe place: the pattern says which pieces are here, up to the next safe place.
        while end < len(text) and not _safe(text, end):
            end += 1
        held: list[str] = []
        for m in regex.finditer(PATTERN, text[at:end]):
            if len(m[0]) * 4 > leaf and len(m[0].encode()) > leaf:
                if held:
                    out.append((-1, "\x00".join(map(str, map(len, held))) + "\x01" + "".join(held)))
                    held = []
                run += 1
                out.extend((run, x) for x in leaves(m[0], leaf))
            else:
                held.append(m[0])
        if held:
            out.append((-1, "\x00".join(map(str, map(len, held))) + "\x01" + "".join(held)))
        at = end
    return out


def _encode_part(enc: tiktoken.Encoding, run: int, part: str) -> list[int]:
    if run == 0:
        return enc.encode_ordinary(part)
    if run > 0:
        return _piece(enc, part.encode("utf-8", "surrogatepass"))
    sizes, _, text = part.partition("\x01")
    out, at = [], 0
    for n in map(int, sizes.split("\x00")):
        out += _piece(enc, text[at : at + n].encode())
        at += n
    return out


def encode_text(enc: tiktoken.Encoding, text: str | None, long: int = LONG, size: int = PART, leaf: int = LEAF) -> list[int]:
    """Ids of one text, in one process, by the same cuts and joins."""
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out, runs = [], {}
    for run, part in parts(text, size, leaf):
        ids = _encode_part(enc, run, part)
        if run > 0:
            runs.setdefault(run, (len(out), []))[1].append(ids)
            if len(runs[run][1]) == 1:
                out.append(None)
        else:
            out.append(ids)
    for at, pieces in runs.values():
        out[at] = join_all(enc, pieces)
    return [i for ids in out for i in ids]


def decoded_hashes(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, md5) of the text that each list of ids stands for: what a round trip is held against."""
    data = load(vocabulary)

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(data)
        for batch in batches(batch_rows):
            found = [hashlib.md5(b"".join(enc.decode_tokens_bytes(ids))).hexdigest() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "md5"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, md5 string")


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, long: int = LONG, size: int = PART, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of each row: ids of the whole text without special tokens, whose strings are plain text.

    Null and empty texts have the empty list. The vocabulary file is read once by the driver and sent
    along, its size is checked. Parts of long texts are spread over the cluster and meet again by row.
    """
    data = load(vocabulary)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def short(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(data)
        for batch in slices(batch_rows, 1):
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def cut_up(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            for key, doc, value in zip(*(c.to_pylist() for c in batch.columns)):
                found = parts(value, size, leaf)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([r for r, _ in found], pa.int32()), pa.array([p for _, p in found], pa.string())],
                    ["key", "doc_id", "seq", "run", "part"],
                )

    def encode_parts(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(data)
        for batch in batches(batch_rows):
            ids = [_encode_part(enc, r, p) for r, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], ["key", "doc_id", "seq", "run", "ids"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        enc = _encoding(data)
        group = group.sort_values("seq")
        out: list[int] = []
        pending: list[list[int]] = []
        last = 0
        for run, ids in zip(group["run"].tolist(), group["ids"]):
            if pending and run != last:
                out += join_all(enc, pending)
                pending = []
            if run > 0:
                pending.append(list(ids))
            else:
                out += list(ids)
            last = run
        out += join_all(enc, pending)
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "ids": [out]})

    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    usual = rows.where(~is_long).mapInArrow(short, "doc_id bigint, ids array<int>")
    large = rows.where(is_long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    spread = large.mapInArrow(cut_up, "key bigint, doc_id bigint, seq int, run int, part string").repartition("key", "seq")
    encoded = spread.mapInArrow(encode_parts, "key bigint, doc_id bigint, seq int, run int, ids array<int>")
    return usual.unionByName(encoded.groupBy("key").applyInPandas(together, "doc_id bigint, ids array<int>"))
