"""Visually identical text with different characters, brought to one form.

Arrow text becomes one numpy code-point array per batch. Lookup tables give each code point its
plain form, its expansion and its class; expansion offsets place forms of several letters, deleted
characters have length 0; marks are composed with their letters by array passes. Only words that
mix scripts need the borders of words, which are array passes too. No string call is made per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import slices
from evidex.functions.codepoints import from_codepoints, gather, row_of, to_codepoints

# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ϲ": "c", "ϳ": "j", "γ": "y", "ω": "w",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ս": "U", "Օ": "O", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "Ɩ": "l", "ɑ": "a", "ɡ": "g", "ı": "i",
}
#: Letters that look alike but whose plain use within their own script is no stand-in for a lone word.
_SMALL_CAPS = set("кмтпгηγωα")
# Forms of the CJK radicals block that have no compatibility mapping.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺇": "几", "⺈": "刀", "⺊": "卜", "⺌": "小", "⺍": "小", "⺕": "彐", "⺗": "心", "⺛": "无", "⺝": "月", "⺟": "母", "⺠": "民", "⺡": "水", "⺢": "水", "⺣": "火", "⺤": "爪", "⺥": "爪",
    "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺮": "竹", "⺰": "纟", "⺱": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺺": "聿", "⺼": "肉", "⺾": "艹", "⻁": "虎", "⻂": "衣", "⻃": "西", "⻄": "西", "⻅": "见", "⻆": "角",
    "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "长", "⻒": "长", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞",
    "⻝": "食", "⻞": "食", "⻟": "食", "⻠": "饣", "⻢": "马", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
}

# Kinds of stand-ins, as bits.
WIDE, SPACE, APART, UNSEEN, MIXED, HAN = 1, 2, 4, 8, 16, 32
KINDS = {"wide": WIDE, "space": SPACE, "apart": APART, "unseen": UNSEEN, "mixed": MIXED, "han": HAN}
#: The tables hold tag characters and all variation selectors; beyond them is private use only.
FORMS_END = 0xE01F0
# Scripts of letters as small numbers; 0 is no letter, 1 is Han and other letters without case.
_SCRIPTS = ["", "HAN", "LATIN", "GREEK", "CYRILLIC", "CHEROKEE", "ARMENIAN", "OTHER"]


class Tables:
    """Lookup tables over code points, made by rule from the Unicode database."""

    def __init__(self) -> None:
        n = FORMS_END
        self.plain = np.arange(n, dtype=np.uint32)
        self.kind = np.zeros(n, np.uint8)
        self.length = np.ones(n, np.int8)
        self.script = np.zeros(n, np.uint8)
        self.mark = np.zeros(n, bool)
        self.alike = np.zeros(n, np.uint32)
        self.lone = np.zeros(n, bool)
        self.order = np.zeros(n, np.uint8)
        self.apart = np.ones(n, np.int8)
        # Where a code point's expansion, or its letter and marks written apart, begin in one flat array.
        self.begin = np.zeros(n, np.int32)
        flat: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(n):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            c = chr(cp)
            kind = unicodedata.category(c)
            if kind == "Cn":
                continue
            if kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800, 0x034F, 0x17B4, 0x17B5):
                if c not in "\t\n\r\v\f\x85\x1c\x1d\x1e\x1f":
                    self.kind[cp], self.length[cp] = UNSEEN, 0
            elif kind == "Zs" and c != " ":
                self.kind[cp], self.plain[cp] = SPACE, 32
            elif kind[0] == "M":
                self.mark[cp] = True
            full = unicodedata.normalize("NFKC", c)
            if 0xFF10 <= cp <= 0xFF5A and full.isascii() and full.isalnum():
                self.kind[cp], self.plain[cp] = WIDE, ord(full)
            elif (0x2E80 <= cp <= 0x2FDF or 0xF900 <= cp <= 0xFAFF or 0x2F800 <= cp <= 0x2FA1F) and (han := RADICALS.get(c) or (full if full != c else "")):
                self.kind[cp], self.plain[cp] = HAN, ord(han)
            elif 0x1D400 <= cp <= 0x1D7FF and len(full) == 1:
                self.kind[cp], self.plain[cp] = WIDE, ord(full)
            elif 0xFB00 <= cp <= 0xFB06:
                self.kind[cp], self.length[cp], self.begin[cp] = WIDE, len(full), len(flat)
                flat += map(ord, full)
            if kind[0] == "L":
                name = unicodedata.name(c, "")
                word = next((s for s in _SCRIPTS[2:7] if name.startswith(s)), "")
                if word:
                    self.script[cp] = _SCRIPTS.index(word)
                elif kind == "Lo" or "IDEOGRAPH" in name:
                    self.script[cp] = 1
                else:
                    self.script[cp] = 2 if self.kind[cp] & WIDE else 7
                if self.kind[cp] & WIDE:
                    self.script[cp] = 2
            self.order[cp] = unicodedata.combining(c)
            loose = unicodedata.normalize("NFD", c)
            if len(loose) > 1 and not 0xAC00 <= cp <= 0xD7A3 and self.length[cp] == 1:
                self.apart[cp], self.begin[cp] = len(loose), len(flat)
                flat += map(ord, loose)
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and "<" not in parts[0] and unicodedata.normalize("NFC", c) == c:
                pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        for c, latin in LOOKALIKES.items():
            self.alike[ord(c)] = ord(latin)
            self.lone[ord(c)] = c not in _SMALL_CAPS
        self.flat = np.array(flat, np.uint32)
        # For Greek and Cyrillic the letter that a Latin one stands for; itself without any.
        self.back = {}
        for s in (3, 4):
            self.back[s] = np.arange(128, dtype=np.uint32)
            for k, v in LOOKALIKES.items():
                if self.script[ord(k)] == s:
                    self.back[s][ord(v)] = ord(k)
        # Letters that may be composed with one before them although they are no marks.
        self.seconds = np.unique(np.array([b for _, b in pairs if unicodedata.combining(chr(b)) == 0], np.uint32))
        keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        # Spacing accents that stand after the letter they belong to.
        self.accents = {0xB4: 0x301, 0xA8: 0x308, 0x2DC: 0x303, 0x2C6: 0x302, 0xB8: 0x327}

    def compose(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Composed code point of each pair, or 0."""
        keys = first.astype(np.int64) << 21 | second.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_to[at], 0).astype(np.uint32)


@cache
def tables() -> Tables:
    return Tables()


def _mixed_words(cps: np.ndarray, rows: np.ndarray, script: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters that stand for letters of another script: where, and what they become."""
    t = tables()
    out, hit = cps.copy(), np.zeros(len(cps), bool)
    letter = script >= 2
    if not len(cps) or not (script > 2).any():
        return hit, out
    # A word is a run of letters of scripts with case; marks and unseen characters do not end it.
    neutral = gather(t.mark.astype(np.uint8), cps, 0).astype(bool) | (gather(t.kind, cps, 0) == UNSEEN)
    core = np.flatnonzero(~neutral)
    inword, r = letter[core], rows[core]
    begins = inword & np.concatenate(([True], ~inword[:-1] | (r[1:] != r[:-1])))
    word = np.cumsum(begins) - 1
    idx, wid = core[inword], word[inword]
    if not len(idx):
        return hit, out
    n = int(wid[-1]) + 1
    s = script[idx]
    count = np.stack([np.bincount(wid, s == k, n) for k in range(2, 8)])
    several = (count > 0).sum(0) > 1
    alike, lone = gather(t.alike, cps[idx], 0), gather(t.lone.astype(np.uint8), cps[idx], 0).astype(bool)
    # A whole word of stand-ins that leans on Han or a digit without a space, as in a one-letter Latin word.
    foreign = (s > 2) & (s < 7)
    all_alike = np.bincount(wid, foreign & lone, n) == np.bincount(wid, np.ones(len(wid)), n)
    first = np.flatnonzero(np.concatenate(([True], wid[1:] != wid[:-1])))
    last = np.concatenate((first[1:] - 1, [len(wid) - 1]))
    pos = np.flatnonzero(inword)
    han = (script[core] == 1) | ((cps[core] >= 48) & (cps[core] <= 57))
    before, after = pos[first] - 1, pos[last] + 1
    leans = np.zeros(n, bool)
    ok = before >= 0
    leans[ok] |= han[before[ok]] & (r[before[ok]] == r[pos[first][ok]])
    ok = after < len(core)
    leans[ok] |= han[after[ok]] & (r[after[ok]] == r[pos[last][ok]])
    short = (np.bincount(wid, minlength=n) <= 3) & all_alike & ~several
    # Or one that a single space parts from a Latin word, in a text without any letter that only its script has.
    telling = np.zeros(int(rows[-1]) + 1, bool)
    telling[r[pos[foreign & ~lone]]] = True
    near = np.zeros(n, bool)
    for gap, other, ok in ((pos[first] - 1, pos[first] - 2, pos[first] >= 2), (pos[last] + 1, pos[last] + 2, pos[last] + 2 < len(core))):
        at = np.flatnonzero(ok)
        near[at] |= (cps[core[gap[at]]] == 32) & (script[core[other[at]]] == 2) & (r[other[at]] == r[pos[first][at]])
    single = short & (leans | near & ~telling[r[pos[first]]])
    # Which script owns a mixed word: Latin where every foreign letter looks Latin, else the commonest.
    strange = np.bincount(wid, foreign & (alike == 0), n) > 0
    own = np.where(strange, count.argmax(0) + 2, 2)
    bad = several | single
    to_latin = bad[wid] & (own[wid] == 2) & foreign
    change = to_latin & (alike > 0)
    out[idx[change]] = alike[change]
    hit[idx[to_latin]] = True
    for k in (3, 4):
        away = bad[wid] & (own[wid] == k) & (s != k)
        out[idx[away]] = gather(t.back[k], cps[idx[away]])
        hit[idx[away]] = True
    for k in (5, 6, 7):
        hit[idx[bad[wid] & (own[wid] == k) & (s != k)]] = True
    return hit, out


def _expand(cps: np.ndarray, single: np.ndarray, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with their forms of any length in place, those of length 1 taken from single, and their rows."""
    t = tables()
    source = np.repeat(np.arange(len(cps)), length)
    out = single[source]
    several = np.flatnonzero(length[source] > 1)
    begin = np.cumsum(length) - length
    out[several] = t.flat[gather(t.begin, cps[source[several]], 0) + several - begin[source[several]]]
    return out, rows[source]


def _compose(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and their marks in composed canonical form, the rows of what is left, and the rows where something was composed.

    Marks are put in canonical order by a stable sort within their letter's run; then the k-th marks of
    all runs are composed together, where no mark of the same class stands between. Letters that are no
    marks, Hangul ones too, compose with the letter right before them.
    """
    t = tables()
    changed: list[np.ndarray] = [np.empty(0, np.int64)]
    order = gather(t.order, cps, 0) if len(cps) else np.empty(0, np.uint8)
    if (order > 0).any():
        # Letters that carry marks are taken apart first, so that all their marks can be put in order.
        starter = np.flatnonzero(order == 0)
        run = np.cumsum(order == 0) - 1
        marked = np.zeros(len(starter), bool)
        carried = run[order > 0]
        marked[carried[carried >= 0]] = True
        touched = (run >= 0) & marked[np.maximum(run, 0)] if len(starter) else np.zeros(len(cps), bool)
        # A run that reaches over a row's end is none of the letter before it.
        if len(starter):
            touched &= rows == rows[starter[np.maximum(run, 0)]]
        length = np.where(touched, gather(t.apart, cps, 1), 1).astype(np.int64)
        if (length != 1).any():
            cps, rows = _expand(cps, cps, length, rows)
            order = gather(t.order, cps, 0)
        begins = (order == 0) | np.concatenate(([True], rows[1:] != rows[:-1]))
        run = np.cumsum(begins) - 1
        by = np.lexsort((order, run))
        cps, order = cps[by], order[by]
        start = np.flatnonzero(begins)
        size = np.diff(np.concatenate((start, [len(cps)])))
        live = np.flatnonzero((size > 1) & (order[start] == 0))
        cps, keep = cps.copy(), np.ones(len(cps), bool)
        blocked = np.zeros(len(start), np.int16)
        k = 1
        while len(live):
            at = start[live] + k
            made = t.compose(cps[start[live]], cps[at])
            fits = (made > 0) & (blocked[live] < order[at])
            cps[start[live[fits]]] = made[fits]
            keep[at[fits]] = False
            changed.append(rows[at[fits]])
            blocked[live[~fits]] = order[at[~fits]]
            k += 1
            live = live[size[live] > k]
        cps, rows = cps[keep], rows[keep]
    # Hangul: a leading consonant and a vowel, then a syllable without a tail and a tail.
    for low, high, nxt, most in ((0x1100, 0x1113, 0x1161, 21), (0xAC00, 0xD7A4, 0x11A8, 27)):
        first = np.flatnonzero((cps[:-1] >= low) & (cps[:-1] < high) & (cps[1:] >= nxt) & (cps[1:] < nxt + most) & (rows[1:] == rows[:-1])) if len(cps) > 1 else np.empty(0, np.int64)
        if low == 0xAC00:
            first = first[(cps[first] - 0xAC00) % 28 == 0]
        if len(first):
            cps = cps.copy()
            a, b = cps[first].astype(np.int64), cps[first + 1].astype(np.int64)
            cps[first] = a + b - 0x11A7 if low == 0xAC00 else 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
            changed.append(rows[first])
            keep = np.ones(len(cps), bool)
            keep[first + 1] = False
            cps, rows = cps[keep], rows[keep]
    while len(cps) > 1:
        second = np.flatnonzero(np.isin(cps[1:], t.seconds) & (rows[1:] == rows[:-1])) + 1
        made = t.compose(cps[second - 1], cps[second])
        second, made = second[made > 0], made[made > 0]
        # Of pairs that share a letter only the first composes in one pass.
        alone = np.concatenate((np.ones(min(len(second), 1), bool), np.diff(second) > 1))
        second, made = second[alone], made[alone]
        if not len(second):
            break
        cps = cps.copy()
        cps[second - 1] = made
        changed.append(rows[second])
        keep = np.ones(len(cps), bool)
        keep[second] = False
        cps, rows = cps[keep], rows[keep]
    return cps, rows, np.unique(np.concatenate(changed))


def normalize(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in one form, their offsets, and for each row the bits of the kinds that were found."""
    t = tables()
    rows = row_of(offsets)
    kind = gather(t.kind, cps, 0).copy()
    mixed, swapped = _mixed_words(cps, rows, gather(t.script, cps, 0))
    kind[mixed] |= MIXED
    out = gather(t.plain, swapped)
    length = gather(t.length, cps, 1).astype(np.int64)
    # Expansion offsets: where each code point's form goes.
    if (length != 1).any():
        out, out_rows = _expand(cps, out, length, rows)
    else:
        out_rows = rows
    # Accents with a space of their own stand after the letter that they belong to.
    for accent, mark in t.accents.items():
        spot = np.flatnonzero(out == accent)
        spot = spot[spot > 0]
        spot = spot[(out_rows[spot] == out_rows[spot - 1])]
        if len(spot):
            fits = t.compose(out[spot - 1], np.full(len(spot), mark, np.uint32)) > 0
            out = out.copy()
            out[spot[fits]] = mark
    out, out_rows, composed = _compose(out, out_rows)
    n = len(offsets) - 1
    found = np.zeros(n, np.int64)
    found[composed] |= APART
    # Marks that no letter in one piece holds still stand apart from their Latin, Greek or Cyrillic letter.
    left = np.flatnonzero(gather(t.mark.astype(np.uint8), out, 0).astype(bool)) if len(out) else np.empty(0, np.int64)
    left = left[left > 0]
    left = left[(out_rows[left] == out_rows[left - 1]) & (gather(t.script, out[left - 1], 0) >= 2)]
    found[out_rows[left]] |= APART
    for bit in KINDS.values():
        hit = rows[(kind & bit) > 0]
        found[np.unique(hit)] |= bit
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(out_rows, minlength=n), out=ends[1:])
    return out, ends, found


def normalize_strings(values: list[str | None]) -> list[str | None]:
    """normalize over Python strings, null for null."""
    array = pa.array(values, pa.string())
    out, ends, _ = normalize(*to_codepoints(array))
    return from_codepoints(out, ends, np.array([v is not None for v in values])).to_pylist()


def unify_text(df: DataFrame, fields: Mapping[str, str], record_id: str) -> DataFrame:
    """One row (field, record_id, text, unified, kinds) for each non-null value of the named fields.

    kinds holds the bits of KINDS that were found, 0 where the text stays as it is. Empty and blank
    texts stay; texts of any length are processed whole. An empty table gives an empty result.
    """
    packed = F.filter(
        F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).cast("string").alias("text")) for name, column in fields.items()]),
        lambda x: x["text"].isNotNull(),
    )
    long = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.explode(packed).alias("x")).select("x.field", "record_id", "x.text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, 2):
            cps, ends, found = normalize(*to_codepoints(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), from_codepoints(cps, ends), pa.array(found.astype(np.int32))],
                ["field", "record_id", "text", "unified", "kinds"],
            )

    return long.mapInArrow(run, "field string, record_id bigint, text string, unified string, kinds int")
