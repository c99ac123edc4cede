"""Column builders over text. Patterns use (?U) and (?d), so that classes and line ends are Unicode's and \\n only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidex.dictionaries import NULL_STARTS, NULL_TOKENS, TitleSpec

EMPTY = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(items: Sequence[str]) -> Column:
    """An array literal of strings, also for no items."""
    return F.array(*map(F.lit, items)) if items else F.array().cast(EMPTY)


#: The white space of Unicode, which (?U)\s matches too.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column, chars: str | None = None) -> Column:
    """Without white space, or the given characters, at both ends."""
    return F.btrim(text, F.lit(WHITE if chars is None else chars))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def first_part(text: Column, separator: str) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(1))


def lookup(key: Column, mapping: Mapping[str, object], default: Column) -> Column:
    """Value of a small literal map, or default."""
    if not mapping:
        return default
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def strip_affixes(text: Column, prefixes: Sequence[str], suffixes: Sequence[str], keep: int = 2) -> Column:
    """Cut listed starts, then listed ends, in list order, again and again until nothing is cut; keep characters stay."""
    if not prefixes and not suffixes:
        return text

    def cutter(front: bool):
        def cut(acc: Column, tok: Column) -> Column:
            n = F.length(acc) - F.length(tok)
            hit = (F.startswith(acc, tok) if front else F.endswith(acc, tok)) & (n >= keep)
            rest = F.substring(acc, F.length(tok) + 1, n) if front else F.substring(acc, F.lit(1), n)
            return F.when(hit, rest).otherwise(acc)

        return cut

    def one_pass(s: Column) -> Column:
        for tokens, front in ((prefixes, True), (suffixes, False)):
            if tokens:
                s = F.aggregate(words(tokens), s, cutter(front))
        return s

    def stable(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), s, lambda acc, _: one_pass(acc))

    ends = [f"^(?:{'|'.join(map(re.escape, prefixes))})"] * bool(prefixes) + [f"(?:{'|'.join(map(re.escape, suffixes))})$"] * bool(suffixes)
    # Most texts have neither, and don't enter the loop.
    return let(text, lambda s: F.when(s.rlike("|".join(ends)), stable(s)).otherwise(s))


# Patterns of what a title's standard form leaves out, in this order.
ASIDE = r"(?d)[（(\[【].*?[)）\]】]"
OPEN_ASIDE = r"(?d)[（(\[【].*$"
JOB_CODE = r"[a-z]{1,3}\p{Nd}{4,}"
TAIL = r"(?d)[-—_/、,，|]+.*$"
EDGE = "·-/ "


def normalize_title(raw: Column, spec: TitleSpec = TitleSpec(), long_title: int = 12) -> Column:
    """Standard form of a free title; a null title is the empty title."""
    def shortened(base: Column) -> Column:
        s = base
        for pattern in (ASIDE, OPEN_ASIDE, JOB_CODE):
            s = F.regexp_replace(s, pattern, "")
        return let(s, lambda t: F.when(F.length(t) > long_title, F.regexp_replace(t, TAIL, "")).otherwise(t))

    def finished(base: Column) -> Column:
        bare = strip(strip_affixes(squeeze(shortened(base)), spec.prefixes, spec.suffixes), EDGE)
        return let(F.coalesce(F.nullif(bare, F.lit("")), base), lambda s: lookup(s, spec.synonyms, s))

    return let(strip(F.lower(F.coalesce(raw, F.lit("")))), finished)


def keyword_hits(text: Column, keywords: Sequence[str], lowered: bool = False) -> Column:
    """Keywords that the lower-cased text holds, in dictionary order; overlapping ones are all reported.

    lowered says that text is a column in lower case without nulls, which then isn't worked out for each keyword.
    """
    if not keywords:
        return F.array().cast(EMPTY)
    low = text if lowered else F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword of the list that the text holds, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]) if keywords else F.lit(None).cast("string")


def pay_median_k(text: Column) -> Column:
    """Middle of a stated pay range in thousands a month: lo-hi K, with N monthly pays, a day, a month; else null."""
    s = F.coalesce(text, F.lit(""))
    num = r"(\p{Nd}+(?:\.\p{Nd}+)?)"

    def middle(pattern: str, factor: Column) -> Column:
        lo, hi = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
        return F.when(lo != "", (lo.try_cast("double") + hi.try_cast("double")) / 2 * factor)

    pays = F.regexp_extract(s, r"(?U)·\s*(\d+)\s*薪", 1)
    months = F.coalesce(F.when(pays != "", pays.try_cast("double")), F.lit(12.0))
    return F.coalesce(
        middle(rf"(?U){num}\s*-\s*{num}\s*[kK]", months / 12),
        middle(r"(?U)(\d+)\s*-\s*(\d+)\s*元/天", F.lit(21.75 / 1000)),
        middle(r"(?U)(\d+)\s*-\s*(\d+)\s*元/月", F.lit(1 / 1000)),
    )


def clean_scalar(text: Column) -> Column:
    """Text without white space and full stops around it, or null where it says that there is no value."""

    def checked(s: Column) -> Column:
        null = F.lower(s).isin(*NULL_TOKENS) | s.isin(*NULL_TOKENS) | s.rlike("^(" + "|".join(NULL_STARTS) + ")")
        return F.when(~null, s)

    return let(strip(strip(strip(text), "。;；")), checked)


def clean_items(items: Column) -> Column:
    """List items without marks and numbers, without empty and null words, each once in any letter case, first spelling kept."""
    bare = F.transform(items, lambda x: F.regexp_replace(strip(strip(strip(x), "。.;；·-—*")), r"(?U)^\d+[.、]\s*", ""))
    kept = F.filter(bare, lambda x: x.isNotNull() & ~F.lower(x).isin(*NULL_TOKENS))

    def once(row: Column) -> Column:
        return F.filter(row["kept"], lambda x, i: F.array_position(row["keys"], F.lower(x)) == i + 1)

    def keyed(xs: Column) -> Column:
        return let(F.struct(xs.alias("kept"), F.transform(xs, F.lower).alias("keys")), once)

    return F.when(items.isNotNull(), let(kept, keyed))


def split_list(text: Column) -> Column:
    """Items of a list written as one text; empty for a null word."""
    parts = F.split(let(text, clean_scalar), r"(?U)[、,，;；/|]\s*|\s{2,}")
    return F.coalesce(let(parts, clean_items), F.array().cast(EMPTY))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form of Unicode; null for null. Spark has no function for it.

    A native test for texts that can't change was tried: working the argument out twice cost more
    than the call saves (field_accuracy 5.3 s without, 8.7 s with it at sf0.1).
    """
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


# Characters and particles that don't count when values are compared.
DROPPED = r"""(?U)[\s\-_·・.。,，、；;:：/／\\|｜()（）\[\]【】“”"'’‘*#>+~!！?？]"""
PARTICLES = "[的与和及等]"


def norm_text(text: Column, wide: bool = True) -> Column:
    """Comparison form of a running text; the empty text for null."""
    s = F.coalesce(text, F.lit(""))
    s = F.lower(nfkc(s) if wide else s)
    return F.regexp_replace(F.regexp_replace(s, DROPPED, ""), PARTICLES, "")


def norm(text: Column, aliases: Mapping[str, str] | None = None, wide: bool = True) -> Column:
    """Comparison form of a value, with aliases mapped to their representative."""
    s = norm_text(text, wide)
    return lookup(s, aliases or {}, s)


def norm_set(items: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Sorted set of the comparison forms of already NFKC-normalised items, empty ones left out."""
    forms = F.transform(F.coalesce(items, F.array().cast(EMPTY)), lambda x: norm(x, aliases, wide=False))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x != "")))


#: Characters that count as one token each.
CJK = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def token_estimate(text: Column) -> Column:
    """Rough number of tokens: one for a CJK character, one for four others."""
    rest = F.length(F.regexp_replace(text, CJK, ""))
    return F.floor((F.length(text) - rest) + rest / 4).cast("int")


def run_seconds(tokens_in: Column, tokens_out: Column, overhead: float = 0.35, prefill: float = 3000.0, decode: float = 42.0) -> Column:
    """Modelled time of one call."""
    return F.lit(overhead) + tokens_in / prefill + tokens_out / decode


def char_wb_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words padded by a blank on each side; a shorter word is emitted whole, once."""
    tokens = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")

    def piece(padded: Column, n: int):
        return lambda i: F.substring(padded, i, F.lit(n))

    def grams(token: Column) -> Column:
        padded = F.concat(F.lit(" "), token, F.lit(" "))
        size = F.length(padded)
        none = F.array().cast(EMPTY)
        parts = [F.when(size > n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), piece(padded, n))).otherwise(none) for n in range(low, high + 1)]
        # A word that fits into the longest n-gram gives itself, once.
        return F.concat(*parts, F.when(size <= high, F.array(padded)).otherwise(none))

    return F.flatten(F.transform(tokens, grams))


#: The place of the text in a template.
SLOT = "{job_description}"


def fill_template(template: str, text: Column, slot: str = SLOT) -> Column:
    """The template with each slot replaced by the text."""
    return F.replace(F.lit(template), F.lit(slot), text)


def delimited(text: Column, separator: str = "|") -> Column:
    """Items of a delimited text, blanks dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), re.escape(separator)), lambda x: x != "")


def level(text: Column, levels: Mapping[str, int], default: int) -> Column:
    """Ordinal level of a text, default for any other and for null."""
    return lookup(text, levels, F.lit(default))


def half_even(value: Column, digits: int) -> Column:
    """Rounded like an array of doubles: scaled, to the nearest whole number, of two the even one.

    Spark's bround rounds the shortest decimal text of a double instead, which differs where the scaled
    value lies on a half.
    """
    return F.rint(value * 10.0**digits) / 10.0**digits
