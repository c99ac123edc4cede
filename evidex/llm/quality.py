"""Per-document text quality statistics and the kinds of text that they tell apart.

The statistics are array passes over code points. A Gaussian mixture is fitted on them, standardized,
by expectation-maximization over all documents: each pass sums the sufficient statistics in the
executors and sends their fixed number to the driver. Labelled examples give the components their
start and, by the documents that they explain, their kind: prose, list, table or junk.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches, slices
from evidex.functions.codepoints import TABLE_SIZE, gather, row_of, sum_by_row, to_codepoints
from evidex.session import cut

KINDS = ("prose", "list", "table", "junk")
STATISTICS = (
    "word_count", "mean_word_length", "longest_word", "symbol_ratio", "digit_ratio", "space_ratio", "comma_ratio", "sentence_ratio",
    "closed_lines", "line_length", "line_spread", "marked_lines", "common_words", "function_letters", "familiarity", "variety",
    "repeated_lines", "fields_per_line", "field_spread", "wide_gaps", "case_turns", "strange_ratio", "han_ratio", "markup_ratio", "closing_marks", "running_text",
)
#: Those of the statistics that the mixture reads.
FEATURES = tuple(s for s in STATISTICS if s != "word_count")
# Common words of English and letters of common function words of Chinese.
COMMON_WORDS = """a about after all also an and any are as at be been before but by can could do each for from had has have he her his how i if in into is it its
more most no not of on one only or other our out over she should so some than that the their them there they this to until up us was we were what when
which while who will with would yet you your don't isn't""".split()
FUNCTION_LETTERS = "的了是在和也都把被就会要从到不但并而且以为与及或又还再已将让给对使其这那此各每我你他她们它所因如果虽则很更最没有能可只才"
_SENTENCE = "。！？!?…"
_CLOSERS = "”\"'’)）】」』"
_COMMA = ",，、;；"
_FIELD = ",，;；|\t：:\""
#: Buckets of letter trigrams: the model that goes to the executors has one byte each.
BUCKETS = 1 << 20
#: Words, and share of function words among them, of a stretch of running text.
LEAST_WORDS, LEAST_FUNCTION = 6, 0.06
#: Components for each kind, and the most labelled documents that give them their start.
COMPONENTS = {"prose": 20, "list": 20, "table": 16, "junk": 20}
MOST_LABELS = 12_000
#: Rows whose terms are worked out at a time.
BLOCK = 2048


class Classes:
    """Classes of code points."""

    def __init__(self) -> None:
        n = TABLE_SIZE
        names = ("letter", "han", "digit", "space", "symbol", "strange", "upper", "lower", "sentence", "comma", "field", "closer", "function", "markup", "bullet")
        t = {name: np.zeros(n, bool) for name in names}
        for cp in range(n):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            c = chr(cp)
            kind = unicodedata.category(c)
            t["letter"][cp] = kind[0] == "L" or kind[0] == "M"
            t["han"][cp] = 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp
            t["digit"][cp] = kind == "Nd"
            t["space"][cp] = c.isspace()
            t["strange"][cp] = (0x7F <= cp <= 0xBF and c not in "·°±²³×é") or cp in (0xFFFD, 0xC2, 0xC3) or 0xE000 <= cp <= 0xF8FF or (kind in ("Cc", "Cn", "Co") and c not in "\t\n\r") or c in "åæçèéäïã¤"[:8]
            t["upper"][cp], t["lower"][cp] = kind == "Lu", kind == "Ll"
            t["symbol"][cp] = kind[0] in "SP" and c not in _SENTENCE + _COMMA + ".()（）“”\"'’-：:"
        for name, chars in (("sentence", _SENTENCE), ("comma", _COMMA), ("field", _FIELD), ("closer", _CLOSERS), ("function", FUNCTION_LETTERS), ("markup", "<>&{}=/\\_#"), ("bullet", "-*•·●▪◦○■□◆+–—>")):
            t[name][[ord(c) for c in chars]] = True
        # All classes of a code point in one number, so that one look-up serves for all of them; code points
        # with the same classes make one sort, and counts of sorts give the counts of all classes at once.
        self.names = names
        self.bit = {name: np.uint16(1 << i) for i, name in enumerate(names)}
        self.bits = sum((t[name].astype(np.uint16) << i) for i, name in enumerate(names)).astype(np.uint16)
        sorts, self.sort = np.unique(np.concatenate((self.bits, [np.uint16(0)])), return_inverse=True)
        self.sort = self.sort[:-1].astype(np.uint8 if len(sorts) <= 256 else np.uint16)
        self.members = ((sorts[:, None] >> np.arange(len(names), dtype=np.uint16)) & 1).astype(float)
        self.fold = np.array([cp if 0xD800 <= cp <= 0xDFFF or len(chr(cp).lower()) != 1 else ord(chr(cp).lower()) for cp in range(n)], np.uint32)
        self.stop = np.sort(_word_hashes([w for w in COMMON_WORDS]))


def _word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        cps = np.array([ord(c) for c in w], np.uint64)
        with np.errstate(over="ignore"):
            out.append((_scatter(cps) * _powers()[: len(cps)]).sum(dtype=np.uint64))
    return np.array(out, np.uint64)


def _scatter(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


@cache
def _powers() -> np.ndarray:
    out = np.ones(4096, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, len(out)):
            out[i] = out[i - 1] * np.uint64(0x94D049BB133111EB)
    return out


@cache
def classes() -> Classes:
    return Classes()


def trigrams(cps: np.ndarray, rows: np.ndarray, bits: np.ndarray | None = None, folded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places whose letter and the two letters after it make a trigram, and its bucket."""
    c = classes()
    if len(cps) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = ((gather(c.bits, cps, 1) if bits is None else bits) & c.bit["letter"]) > 0
    at = np.flatnonzero(letter[:-2] & letter[1:-1] & letter[2:])
    at = at[rows[at] == rows[at + 2]]
    f = (gather(c.fold, cps) if folded is None else folded).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = f[:-2] * np.uint64(0x1F1F1F1F1)
        h += f[1:-1] * np.uint64(0x3D3D3D3)
        h += f[2:] * np.uint64(0x10001)
        h = _scatter(h[at])
    return at, (h >> np.uint64(44)).astype(np.int64)


def trigram_model(texts: DataFrame) -> np.ndarray:
    """Familiarity of each trigram bucket from 0 to 255, from its count in all documents."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(rows, 0):
            cps, offsets = to_codepoints(batch.column(0))
            total += np.bincount(trigrams(cps, row_of(offsets))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS numbers, whatever the size of the corpus.
    found = counted.toArrow()
    n = np.zeros(BUCKETS)
    n[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    rate = np.log2((n + 0.02) / max(1.0, n.sum()))
    return np.clip((rate + 26) * 14, 0, 255).astype(np.uint8)


def statistics(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; null and empty texts give zeros."""
    c = classes()
    cps, offsets = to_codepoints(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    if not len(cps):
        return out
    rows = row_of(offsets)
    # The places of code points in the tables; those beyond them are in no class and fold to themselves.
    inside = cps < TABLE_SIZE
    if inside.all():
        places = cps.astype(np.intp)
        bits, folded, sort = c.bits[places], c.fold[places], c.sort[places]
    else:
        places = np.where(inside, cps, 0).astype(np.intp)
        bits, folded, sort = np.where(inside, c.bits[places], 0).astype(np.uint16), np.where(inside, c.fold[places], cps), np.where(inside, c.sort[places], 0).astype(c.sort.dtype)
    has = {name: (bits & c.bit[name]) != 0 for name in ("letter", "han", "digit", "space", "upper", "lower", "sentence", "field", "closer", "function")}
    sizes_of = np.diff(offsets)
    total = np.maximum(sizes_of, 1).astype(float)
    kinds = len(c.members)
    counted = np.bincount(np.repeat(np.arange(n, dtype=np.intp) * kinds, sizes_of) + sort, minlength=n * kinds).reshape(n, kinds) @ c.members
    count = dict(zip(c.names, counted.T))
    # Whether a code point and the one after it are of one row.
    joined = np.ones(len(cps) - 1, bool)
    borders = offsets[1:-1]
    joined[borders[(borders > 0) & (borders < len(cps))] - 1] = False

    def per(places: np.ndarray) -> np.ndarray:
        """How many of the places each row has."""
        return np.bincount(rows[places], minlength=n).astype(float)

    def put(name: str, values: np.ndarray) -> None:
        out[:, STATISTICS.index(name)] = values

    letters = np.maximum(count["letter"], 1)
    visible = np.maximum(sizes_of - count["space"], 1)
    # Words: runs of letters and digits that aren't Han; a Han character is half a word.
    inner = ((bits & (c.bit["letter"] | c.bit["digit"])) != 0) | (cps == 39)
    inner &= ~has["han"]
    first = inner.copy()
    first[1:] &= ~(inner[:-1] & joined)
    starts = np.flatnonzero(first)
    words, plain = np.zeros(n), np.zeros(n)
    common = np.zeros(len(cps), np.float32)
    longest, word_letters = np.zeros(n), np.zeros(n)
    if len(starts):
        idx = np.flatnonzero(inner)
        begins = np.flatnonzero(first[idx])
        sizes = np.diff(np.concatenate((begins, [len(idx)])))
        place = np.minimum(idx - np.repeat(starts, sizes), 4095)
        with np.errstate(over="ignore"):
            values = _scatter(folded[idx].astype(np.uint64)) * _powers()[place]
            hashes = np.add.reduceat(values, begins)
        at = np.minimum(np.searchsorted(c.stop, hashes), len(c.stop) - 1)
        row = rows[starts]
        common[starts] = c.stop[at] == hashes
        words, plain = np.bincount(row, minlength=n).astype(float), np.bincount(row, common[starts], n)
        word_letters = np.bincount(row, sizes, n)
        own = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        longest[row[own]] = np.maximum.reduceat(sizes, own)
    han = count["han"]
    put("word_count", words + han / 2)
    put("mean_word_length", np.log1p(word_letters / np.maximum(words, 1)))
    put("longest_word", np.log1p(longest))
    put("common_words", plain / np.maximum(words, 3))
    put("function_letters", count["function"] / np.maximum(han, 8))
    put("han_ratio", han / letters)
    put("symbol_ratio", np.sqrt(count["symbol"] / visible))
    put("digit_ratio", np.sqrt(count["digit"] / visible))
    put("space_ratio", np.sqrt(count["space"] / total))
    put("comma_ratio", np.sqrt(count["comma"] / visible))
    put("markup_ratio", np.sqrt(count["markup"] / visible))
    put("strange_ratio", np.sqrt(count["strange"] / visible))
    put("closing_marks", np.sqrt(count["closer"] / visible))
    # Sentence ends: their marks, and points after a letter before a space, a closer or the end.
    point = np.flatnonzero(cps == 46)
    point = point[point > 0]
    point = point[joined[point - 1] & ((bits[point - 1] & (c.bit["lower"] | c.bit["closer"])) != 0)]
    after = np.minimum(point + 1, len(cps) - 1)
    point = point[(after == point) | ~joined[np.minimum(point, len(joined) - 1)] | ((bits[after] & (c.bit["space"] | c.bit["closer"])) != 0)]
    ends = has["sentence"].copy()
    ends[point] = True
    put("sentence_ratio", np.sqrt(per(np.flatnonzero(ends)) / visible))
    turn = np.flatnonzero(joined & (has["lower"][:-1] & has["upper"][1:] | has["letter"][:-1] & has["digit"][1:] & ~has["han"][:-1]))
    put("case_turns", np.sqrt(per(turn) / visible))
    # Wide gaps end where a character follows two spaces.
    spaces = np.flatnonzero(cps == 32)
    twice = spaces[:-1][np.diff(spaces) == 1] + 2
    twice = twice[twice < len(cps)]
    gaps = twice[(cps[twice] != 32) & (rows[twice] == rows[twice - 2])]
    # Lines: numbered over the batch; blank ones left out.
    newline = (cps == 10) | (cps == 13)
    # Running text: the share of characters in stretches, up to the next sentence end or line end, that
    # have words enough and the function words that running text has.
    piece = ends | newline
    piece[:-1] |= ~joined
    edge = np.concatenate(([0], np.flatnonzero(piece[:-1]) + 1))
    size = np.add.reduceat((has["han"] | first).view(np.uint8), edge, dtype=np.int64)
    marks_of = np.add.reduceat(has["function"] + np.float32(0.4) * common, edge, dtype=np.float64)
    seen = np.add.reduceat((~has["space"]).view(np.uint8), edge, dtype=np.int64)
    running = (size >= LEAST_WORDS) & (marks_of >= LEAST_FUNCTION * size)
    put("running_text", np.bincount(rows[edge], seen * running, n) / visible)
    begins_line = ~newline
    begins_line[1:] &= newline[:-1] | ~joined
    start = np.flatnonzero(begins_line)
    if len(start):
        # A line reaches to the next one's start; the line ends in between count for nothing.
        k = len(start)
        row = rows[start]
        last = start + np.add.reduceat((~newline).view(np.uint8), start, dtype=np.int64) - 1
        length = np.add.reduceat((~has["space"]).view(np.uint8), start, dtype=np.int64)
        full = length > 0
        lines = np.maximum(np.bincount(row[full], minlength=n), 1).astype(float)
        chars = np.bincount(row[full], length[full], n)
        mean = chars / lines
        put("line_length", np.log1p(mean))
        put("line_spread", np.sqrt(np.maximum(np.bincount(row[full], length[full].astype(float) ** 2, n) / lines - mean**2, 0)) / np.maximum(mean, 1))
        # The last character of a line that isn't a space or a closer, and the first that isn't a space.
        solid = np.flatnonzero((bits & (c.bit["space"] | c.bit["closer"])) == 0)
        at = np.searchsorted(solid, last, side="right") - 1
        tail = solid[np.maximum(at, 0)] if len(solid) else np.zeros(k, np.int64)
        there = (at >= 0) & (tail >= start)
        seen = np.flatnonzero(~has["space"])
        at = np.searchsorted(seen, start)
        head = seen[np.minimum(at, len(seen) - 1)] if len(seen) else np.full(k, len(cps) - 1)
        head = np.where((at < len(seen)) & (head <= last), head, len(cps) - 1)
        closed = ends[tail] & there
        put("closed_lines", np.bincount(row, closed, n) / lines)
        nxt, nxt2, nxt3 = (np.minimum(head + d, last) for d in (1, 2, 3))

        def mark(places: np.ndarray) -> np.ndarray:
            x = cps[places]
            return (x == 46) | (x == 0x3001) | (x == 41) | (x == 0xFF09) | (x == 0xFF0E)

        numbered = (has["digit"][head] | ((cps[head] >= 97) & (cps[head] <= 122))) & mark(nxt) | has["digit"][head] & has["digit"][nxt] & mark(nxt2)
        bracket = ((cps[head] == 40) | (cps[head] == 0xFF08) | (cps[head] == 91)) & (mark(nxt2) | mark(nxt3))
        marked = ((bits[head] & c.bit["bullet"]) != 0) & has["space"][nxt] | numbered | bracket
        put("marked_lines", np.bincount(row, marked & full & ~closed, n) / lines)
        wide = np.bincount(np.searchsorted(start, gaps[~newline[gaps]], side="right") - 1, minlength=k)
        fields = np.add.reduceat(has["field"].view(np.uint8), start, dtype=np.int64) + wide
        per_line = np.bincount(row[full], fields[full], n) / lines
        put("fields_per_line", np.log1p(per_line))
        put("field_spread", np.sqrt(np.maximum(np.bincount(row[full], fields[full].astype(float) ** 2, n) / lines - per_line**2, 0)) / (per_line + 1))
        put("wide_gaps", np.sqrt(np.bincount(row[full], wide[full], n) / lines))
        span = np.diff(np.concatenate((start, [len(cps)])))
        place = np.minimum(np.arange(start[0], len(cps)) - np.repeat(start, span), 4095)
        with np.errstate(over="ignore"):
            values = _scatter(cps[start[0] :].astype(np.uint64)) * _powers()[place]
            values[newline[start[0] :]] = 0
            line_hash = np.add.reduceat(values, start - start[0])
            key = (line_hash[full] >> np.uint64(24)) ^ (row[full].astype(np.uint64) << np.uint64(40))
        once, index = np.unique(key, return_index=True)
        different = np.bincount(row[full][index], minlength=n)
        put("repeated_lines", np.where(different > 0, 1 - different / lines, 0))
    at, bucket = trigrams(cps, rows, bits, folded)
    row = rows[at]
    grams = np.bincount(row, minlength=n).astype(float)
    put("familiarity", np.where(grams > 0, np.bincount(row, model[bucket], n) / np.maximum(grams, 1) / 25, 0))
    pairs = np.sort(row.astype(np.int64) << 20 | bucket)
    first = np.concatenate((np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]))
    different = np.bincount(pairs[first] >> 20, minlength=n)
    put("variety", np.log1p(different) / np.log(np.maximum(grams, 1) + 2))
    return out


def document_statistics(df: DataFrame, doc_id: str, text: str, keep_blank: bool = True) -> DataFrame:
    """(doc_id, STATISTICS...) of each document. Null, empty and blank texts have zeros, or no row with keep_blank False."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if not keep_blank:
        # Java's \S doesn't know all spaces, so the marks and wide spaces are named.
        rows = rows.where(F.coalesce(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]"), F.lit(False)))
    model = trigram_model(rows.where(F.col("text").isNotNull()))

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batch_rows, 1):
            found = statistics(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(found.shape[1]))], ["doc_id", *STATISTICS])

    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS))


@cache
def _pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _terms(x: np.ndarray) -> np.ndarray:
    """1, the features and their products of each row, as columns: what densities and sufficient statistics are linear in."""
    n, d = x.shape
    out = np.empty((1 + d + d * (d + 1) // 2, n))
    out[0] = 1
    own = out[1 : 1 + d]
    own[:] = x.T
    at = 1 + d
    for i in range(d):
        np.multiply(own[i], own[i:], out=out[at : at + d - i])
        at += d - i
    return out


class Mixture:
    """Gaussian mixture with full covariances that lean on a small common one.

    The logarithm of a component's density is linear in the terms of a row, so one product of matrices
    gives all of them, and another one all sufficient statistics.
    """

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.weights, self.means, self.covariances = weights, means, covariances
        d = means.shape[1]
        i, j = _pairs(d)
        precisions = np.linalg.inv(covariances)
        pulls = np.einsum("kij,kj->ki", precisions, means)
        logs = np.log(np.maximum(weights, 1e-300)) - 0.5 * np.linalg.slogdet(covariances)[1] - 0.5 * np.einsum("ki,ki->k", pulls, means)
        self.table = np.concatenate((logs[:, None], pulls, precisions[:, i, j] * np.where(i == j, -0.5, -1.0)), 1)

    def of_terms(self, terms: np.ndarray) -> np.ndarray:
        """Responsibilities of the components, one row each, for the rows of the terms."""
        log = self.table @ terms
        log -= log.max(0)
        np.exp(log, out=log)
        log /= log.sum(0)
        return log

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for at in range(0, len(x), BLOCK):
            out[at : at + BLOCK] = self.of_terms(_terms(x[at : at + BLOCK])).T
        return out


def _m_step(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, prior: float, floor: float) -> Mixture:
    d = s1.shape[1]
    means = s1 / np.maximum(n, 1e-9)[:, None]
    common = np.eye(d) * floor
    cov = np.stack([(s2[k] - n[k] * np.outer(means[k], means[k]) + prior * common) / (n[k] + prior) + np.eye(d) * 1e-3 for k in range(len(n))])
    return Mixture((n + 1) / (n + 1).sum(), means, cov)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centres by farthest-first seeds and a few rounds; deterministic."""
    centres = [x.mean(0)]
    distance = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[int(distance.argmax())])
        distance = np.minimum(distance, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(10):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)


def doubtful(x: np.ndarray, kinds: np.ndarray, documents: np.ndarray, k: int = 5, most: int = 4, reach: float = 1.6, own: float = 1.3) -> np.ndarray:
    """Labels that at least `most` of the `k` nearest examples of other documents contradict with one other kind.

    Only where the example lies among these, as near to them as they are to theirs, and no example of its
    own kind is about as near: a rare sort of text, or one between two kinds, keeps its label.
    """
    out = np.zeros(len(x), bool)
    if len(x) <= k + 1:
        return out
    square = (x**2).sum(1)
    near, far, alike = np.empty((len(x), k), np.int64), np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), 1024):
        d = square[at : at + 1024, None] + square[None, :] - 2 * x[at : at + 1024] @ x.T
        d[documents[at : at + 1024, None] == documents[None, :]] = np.inf
        near[at : at + 1024] = np.argpartition(d, k, axis=1)[:, :k]
        far[at : at + 1024] = np.sqrt(np.maximum(np.take_along_axis(d, near[at : at + 1024], 1), 0)).mean(1)
        d[kinds[at : at + 1024, None] != kinds[None, :]] = np.inf
        alike[at : at + 1024] = np.sqrt(np.maximum(d.min(1), 0))
    votes = np.stack([(kinds[near] == j).sum(1) for j in range(len(KINDS))], 1)
    votes[np.arange(len(x)), kinds] = 0
    return (votes.max(1) >= most) & (far <= reach * np.median(far[near], axis=1)) & (alike > own * far)


def _add_sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches(rows):
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[k] = held.get(k, 0) + np.frombuffer(data)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["k", "sums"])


def _moments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 + 2 * len(FEATURES))
    for batch in batches(rows):
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        total += np.concatenate(([x.shape[1]], x.sum(1), (x * x).sum(1)))
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "sums"])


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of fixed size by key, added up in the executors."""
    out: dict[int, np.ndarray] = {}
    added = parts.repartition("k").mapInArrow(_add_sums, "k int, sums binary").toArrow()
    for k, data in zip(added.column("k").to_pylist(), added.column("sums").to_pylist()):
        out[k] = out.get(k, 0) + np.frombuffer(data)
    return out


def fit_mixture(stats: DataFrame, labels: DataFrame, rounds: int = 6, splits: int = 2, prior: float = 6.0, floor: float = 0.15) -> tuple[np.ndarray, np.ndarray, Mixture, np.ndarray]:
    """Centre and scale of the features, the mixture, and the share of each kind in each component.

    stats has one row a document, labels has (doc_id, kind). The start comes from at most MOST_LABELS
    labelled documents, taken by hash; every round of the fit covers all documents, and so do centre
    and scale. A document with several labels counts for each.
    """
    d = len(FEATURES)
    moments = _added(stats.select(*FEATURES).mapInArrow(_moments, "k int, sums binary")).get(0, np.zeros(1 + 2 * d))
    many = max(moments[0], 1.0)
    centre = moments[1 : 1 + d] / many
    scale = np.sqrt(np.maximum(moments[1 + d :] / many - centre**2, 1e-12))
    known = labels.where(F.col("kind").isin(*KINDS)).select("doc_id", "kind")
    sample = known.orderBy(F.xxhash64("doc_id", "kind")).limit(MOST_LABELS)
    seen = stats.join(F.broadcast(sample), "doc_id").select("kind", "doc_id", *FEATURES).orderBy("doc_id", "kind").toArrow()
    kinds = np.array([KINDS.index(k) for k in seen.column("kind").to_pylist()], np.int64)
    x = (np.stack([seen.column(c).to_numpy() for c in FEATURES], 1) - centre) / scale
    if not len(kinds):
        raise ValueError("no labelled document has statistics")
    # Wrong labels among right ones teach nothing.
    clean = ~doubtful(x, kinds, seen.column("doc_id").to_numpy())
    kinds, x = kinds[clean], x[clean]
    groups: list[np.ndarray] = []
    for k, kind in enumerate(KINDS):
        own = x[kinds == k]
        if len(own):
            near = _kmeans(own, min(COMPONENTS[kind], max(1, len(own) // 3)))
            groups += [own[near == j] for j in np.unique(near)]
    mixture = _m_step(np.array([float(len(g)) for g in groups]), np.array([g.sum(0) for g in groups]), np.array([g.T @ g for g in groups]), prior, floor)

    def step(current: Mixture, size: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, width))
            for batch in batches(rows):
                z = (np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)], 1) - centre) / scale
                for at in range(0, len(z), BLOCK):
                    terms = _terms(z[at : at + BLOCK])
                    sums += current.of_terms(terms) @ terms.T
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], ["k", "sums"])

        return run

    inputs = stats.select(*FEATURES)
    upper = _pairs(d)
    width = 1 + d + len(upper[0])

    def refine(current: Mixture, times: int) -> tuple[Mixture, np.ndarray]:
        for _ in range(times):
            size = len(current.means)
            parts = inputs.mapInArrow(step(current, size), "k int, sums binary")
            total = np.zeros((size, width))
            for k, sums in _added(parts).items():
                total[k] = sums
            squares = np.zeros((size, d, d))
            squares[:, upper[0], upper[1]] = squares[:, upper[1], upper[0]] = total[:, 1 + d :]
            current = _m_step(total[:, 0], total[:, 1 : 1 + d], squares, prior, floor)
        return current, np.stack([current.responsibilities(x)[kinds == k].sum(0) for k in range(len(KINDS))], 1)

    mixture, held = refine(mixture, rounds)
    for _ in range(splits):
        # A component whose examples have several kinds starts again as one component for each of them.
        owner = mixture.responsibilities(x).argmax(1)
        starts = []
        for k in range(len(mixture.means)):
            own = [x[(owner == k) & (kinds == j)] for j in range(len(KINDS))]
            several = [g for g in own if len(g) >= 3]
            if len(several) > 1:
                starts += [(g.mean(0), np.cov(g.T, bias=True) * len(g) / (len(g) + prior) + np.eye(d) * (floor * prior / (len(g) + prior) + 1e-3), mixture.weights[k] * len(g) / sum(map(len, several))) for g in several]
            else:
                starts.append((mixture.means[k], mixture.covariances[k], mixture.weights[k]))
        if len(starts) == len(mixture.means):
            break
        mixture, held = refine(Mixture(np.array([w for _, _, w in starts]), np.array([m for m, _, _ in starts]), np.stack([c for _, c, _ in starts])), rounds // 2)
    # Of the five examples nearest to a component's mean those within its reach count too, half each, so that
    # they outvote a single wrong label.
    for k, mean in enumerate(mixture.means):
        d = ((x - mean) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[:5]
        near = near[d[near] <= 2 * np.trace(mixture.covariances[k])]
        held[k] += 0.5 * np.bincount(kinds[near], minlength=len(KINDS))
    held += 1e-6
    return centre, scale, mixture, held / held.sum(1, keepdims=True)


def document_kinds(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, certainty) of each document that isn't null, empty or blank.

    Each component stands for the kind that most of its labelled documents have, so single wrong
    labels have no say; the kind of a document is that with the largest sum of responsibilities.
    """
    stats = cut(document_statistics(df, doc_id, text, keep_blank=False))
    if stats.isEmpty():
        return df.sparkSession.createDataFrame([], "doc_id bigint, kind string, certainty double")
    centre, scale, mixture, shares = fit_mixture(stats, labels)
    kind_of = np.eye(len(KINDS))[shares.argmax(1)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            z = (np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1) - centre) / scale
            p = mixture.responsibilities(z) @ kind_of
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([KINDS[k] for k in best], pa.string()), pa.array(p.max(1))], ["doc_id", "kind", "certainty"])

    return stats.select("doc_id", *FEATURES).mapInArrow(run, "doc_id bigint, kind string, certainty double")
