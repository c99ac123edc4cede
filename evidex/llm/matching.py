"""Mapping free-entered values to a canonical list: prefix-filter set-similarity join.

Values are brought to one form. Words that are commonly added around entries are learned from the
values that hold an entry literally, and stripped from the others. A form is the multiset of its
characters and numbers; these are ordered by rarity, only rare prefixes are joined, length and
positional filters thin out the candidates, the Jaccard similarity is worked out exactly and the best
entry is kept. Characters, not pairs of them, because one slip in a short title leaves few pairs as
they were.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches, slices
from evidex.functions.codepoints import from_codepoints, gather, row_of, to_codepoints
from evidex.llm.forms import normalize
from evidex.session import cut

#: Least similarity of a match, and how many different entries must show an added word.
THRESHOLD, AFFIX_SUPPORT = 0.5, 2
#: No letter or digit has a code point from here on.
LETTERS_END = 0x40000


@cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    lower, keep = np.arange(LETTERS_END, dtype=np.uint32), np.zeros(LETTERS_END, np.uint8)
    for cp in range(LETTERS_END):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if c.isalnum():
            keep[cp] = 1
            low = c.lower()
            # Accents don't tell entries apart: the letter under the mark stands for both.
            bare = unicodedata.normalize("NFD", low)[0] if not 0xAC00 <= cp <= 0xD7A3 else low
            lower[cp] = ord(bare) if len(bare) == 1 else cp
    return lower, keep


def _letters(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, value, form): values as lower-case letters and digits in one form."""
    lower, keep = _fold()
    for batch in slices(rows, 1):
        cps, ends, _ = normalize(*to_codepoints(batch.column(1)))
        wanted = gather(keep, cps, 0).astype(bool)
        left = row_of(ends)[wanted]
        offs = np.zeros(len(ends), np.int64)
        np.cumsum(np.bincount(left, minlength=len(ends) - 1), out=offs[1:])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), from_codepoints(gather(lower, cps[wanted]), offs)], ["list", "value", "form"])


def distinct_forms(values: DataFrame) -> DataFrame:
    """(list, value, form) of the distinct non-null values of a table (list, value)."""
    once = values.where(F.col("value").isNotNull()).groupBy("list", "value").count().select("list", "value")
    return once.mapInArrow(_letters, "list string, value string, form string")


def _tokens(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, key, form, tokens): a form's units with their occurrence numbers, so that sets of them are multisets.

    A unit is a character or a whole run of digits.
    """
    for batch in slices(rows, 2):
        cps, offsets = to_codepoints(batch.column(2))
        rows_of = row_of(offsets)
        digit = (cps >= 48) & (cps <= 57)
        begins = np.ones(len(cps), bool)
        begins[1:] = ~(digit[1:] & digit[:-1]) | (rows_of[1:] != rows_of[:-1])
        start = np.flatnonzero(begins)
        units = cps[start].astype(np.int64)
        if digit.any():
            place = np.arange(len(cps)) - np.repeat(start, np.diff(np.concatenate((start, [len(cps)]))))
            with np.errstate(over="ignore"):
                h = (cps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                run = np.add.reduceat(h ^ (h >> np.uint64(32)), start)
            # Numbers lie above all code points, in 40 bits.
            units = np.where(digit[start], (1 << 40) | (run >> np.uint64(24)).astype(np.int64), units)
        unit_rows = rows_of[start]
        by = np.lexsort((units, unit_rows))
        units = units[by]
        new = np.ones(len(by), bool)
        new[1:] = (units[1:] != units[:-1]) | (unit_rows[1:] != unit_rows[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        tokens = (np.arange(len(by)) - first) << 41 | units
        ends = np.zeros(len(offsets), np.int32)
        np.cumsum(np.bincount(unit_rows, minlength=len(offsets) - 1), out=ends[1:])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens, pa.int64()))], ["list", "key", "form", "tokens"])


def with_tokens(forms: DataFrame, key: str, kind: str) -> DataFrame:
    """(list, key, form, tokens) of a table (list, key, form)."""
    return forms.select("list", F.col(key).alias("key"), "form").mapInArrow(_tokens, f"list string, key {kind}, form string, tokens array<bigint>")


def _grams(form: Column, n: int) -> Column:
    return F.when(F.length(form) >= n, F.transform(F.sequence(F.lit(1), F.length(form) - (n - 1)), lambda i: F.substring(form, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """Values that hold an entry literally, with the longest such entry: (list, value, form, ref_id, entry, before, after).

    An entry that ends or begins with a digit isn't held where the number goes on.
    """
    grams = entries.select("list", "ref_id", "entry", F.explode(F.array_distinct(_grams(F.col("entry"), 2))).alias("gram"))
    rarity = grams.groupBy("list", "gram").agg(F.count("*").alias("df"))
    rare = grams.join(rarity, ["list", "gram"]).groupBy("list", "ref_id", "entry").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    seen = forms.select("list", "value", "form", F.explode(F.array_distinct(_grams(F.col("form"), 2))).alias("gram"))
    hit = seen.join(rare, ["list", "gram"]).where(F.col("form").contains(F.col("entry"))).select(
        "list", "value", "form", "ref_id", "entry",
        F.expr("substring(form, 1, locate(entry, form) - 1)").alias("before"), F.expr("substring(form, locate(entry, form) + length(entry))").alias("after"),
    )
    goes_on = (F.col("before").rlike("[0-9]$") & F.col("entry").rlike("^[0-9]")) | (F.col("after").rlike("^[0-9]") & F.col("entry").rlike("[0-9]$"))
    longest = F.max_by(F.struct("ref_id", "entry", "before", "after"), F.struct(F.length("entry"), -F.col("ref_id")))
    return hit.where(~goes_on).groupBy("list", "value", "form").agg(longest.alias("m")).select("list", "value", "form", "m.*")


def _units(form: Column) -> Column:
    """Characters and whole runs of digits."""
    return F.regexp_extract_all(form, F.lit("(?s)[0-9]+|[^0-9]"), F.lit(0))


def _numbers(text: Column) -> Column:
    """Each run of digits as one #, so that added numbers and codes are one affix."""
    return F.regexp_replace(text, "[0-9]+", "#")


def learn_affixes(held: DataFrame, support: int = AFFIX_SUPPORT) -> DataFrame:
    """(list, side, affix): texts found before or after at least `support` different entries, of any length."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), _numbers(F.col(side)).alias("affix")) for side in ("before", "after")])
    usable = held.select("list", "ref_id", F.explode(sides).alias("x")).select("list", "ref_id", "x.*").where((F.length("affix") >= 2) | (F.col("affix") == "#"))
    return usable.groupBy("list", "side", "affix").agg(F.countDistinct("ref_id").alias("n")).where(F.col("n") >= support).select("list", "side", "affix")


def strip_affixes(forms: DataFrame, affixes: DataFrame) -> DataFrame:
    """(list, value, form): the longest known text before and after is cut off, where two characters stay.

    Only starts and ends as long as some known affix are looked up, each run of digits as one character.
    """
    lengths = affixes.select("list", "side", F.length("affix").alias("k")).distinct().groupBy("list").agg(F.collect_set(F.struct("side", "k")).alias("lengths"))
    split = forms.withColumn("units", _units(F.col("form")))
    asked = split.join(lengths, "list", "left").select("list", "value", "form", "units", F.explode_outer(F.filter("lengths", lambda x: x["k"] <= F.size("units") - 2)).alias("x"))
    part = F.when(F.col("x.side") == "before", F.slice("units", F.lit(1), F.col("x.k"))).otherwise(F.slice("units", -F.col("x.k"), F.col("x.k")))
    asked = asked.select("list", "value", "form", F.col("x.side").alias("side"), F.col("x.k").alias("k"), _numbers(F.array_join(part, "")).alias("affix"))
    known = asked.join(affixes.withColumn("known", F.lit(True)), ["list", "side", "affix"], "left")
    longest = known.groupBy("list", "value", "form").agg(*[F.coalesce(F.max(F.when(F.col("known") & (F.col("side") == s), F.col("k"))), F.lit(0)).alias(a) for s, a in (("before", "b"), ("after", "a"))])
    both = longest.withColumn("units", _units(F.col("form"))).withColumn("fits", F.col("b") + F.col("a") <= F.size("units") - 2)
    b = F.when(F.col("fits") | (F.col("b") >= F.col("a")), F.col("b")).otherwise(0)
    a = F.when(F.col("fits") | (F.col("b") < F.col("a")), F.col("a")).otherwise(0)
    return both.select("list", "value", F.array_join(F.slice("units", b + 1, F.greatest(F.size("units") - a - b, F.lit(0))), "").alias("form"))


def similar_entries(forms: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(list, value, ref_id, jaccard) of the best entry of each value with Jaccard of at least threshold.

    The order of tokens: those that no entry has come first, then the rarest over both sides. Any two sets
    of Jaccard t or more share a token among the first n - ceil(t n) + 1 of each, so only prefixes are joined,
    and of a value's prefix only the tokens that entries have.
    """
    t = F.lit(threshold)
    # The values' tokens are read three times.
    values = cut(with_tokens(forms, "value", "string"))
    listed = with_tokens(entries.select("list", "ref_id", F.col("entry").alias("form")), "ref_id", "bigint")
    entry_tokens = listed.select("list", "key", "form", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    value_tokens = values.select("list", "key", "form", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    used = value_tokens.groupBy("list", "token").agg(F.count("*").alias("v"))
    order = entry_tokens.groupBy("list", "token").agg(F.count("*").alias("e")).join(used, ["list", "token"], "left")
    order = order.select("list", "token", (F.col("e") + F.coalesce("v", F.lit(0))).alias("df"))

    def prefixes(tokens: DataFrame, key: str) -> DataFrame:
        sets = tokens.join(order, ["list", "token"]).groupBy("list", "key", "form", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token")))["token"].alias("shared"))
        lead = F.col("n") - F.size("shared")
        length = F.col("n") - F.ceil(F.col("n") * t - F.lit(1e-9)).cast("int") + 1 - lead
        first = sets.where(length > 0).select("list", F.col("key").alias(key), "form", "n", "shared", lead.alias("lead"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "token"))
        return first.withColumn("pos", F.col("lead") + F.col("at")).drop("lead", "at")

    left = prefixes(value_tokens, "value")
    right = prefixes(entry_tokens, "ref_id").select("list", "token", "ref_id", F.col("form").alias("entry"), F.col("n").alias("rn"), F.col("shared").alias("r_shared"), F.col("pos").alias("rpos"))
    need = t / (t + 1) * (F.col("n") + F.col("rn"))
    room = F.lit(1) + F.least(F.col("m.n") - F.col("m.pos") - 1, F.col("m.rn") - F.col("m.rpos") - 1)
    candidates = (
        left.join(right, ["list", "token"])
        .where((F.col("rn") >= F.col("n") * t - 1e-9) & (F.col("n") >= F.col("rn") * t - 1e-9))
        # Positional filter: tokens before the first shared one can't be shared.
        .groupBy("list", "value", "form", "ref_id", "entry").agg(F.min(F.struct("pos", "rpos", "n", "rn", "shared", "r_shared")).alias("m"), F.first(need).alias("need"))
        .where(room >= F.col("need") - 1e-9)
    )
    both = F.size(F.array_intersect("m.shared", "m.r_shared"))
    scored = candidates.withColumn("jaccard", both / (F.col("m.n") + F.col("m.rn") - both)).where(F.col("jaccard") >= t - 1e-9)
    pairs = F.size(F.array_intersect(F.array_distinct(_grams(F.col("form"), 2)), F.array_distinct(_grams(F.col("entry"), 2))))
    best = scored.groupBy("list", "value").agg(F.max_by(F.struct("ref_id", "jaccard"), F.struct("jaccard", pairs, -F.col("ref_id"))).alias("m"))
    return best.select("list", "value", "m.*")


def map_lists(values: DataFrame, references: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(list, value, ref_id, jaccard, way) for each distinct non-null value of (list, value); ref_id -1 and nulls where none is meant.

    references has (list, ref_id, entry); each value is matched with the entries of its list. way is
    "holds" for a value that is an entry with other words around it, the longest such entry, else
    "similar"; jaccard is that of the whole form in the first case, of the form without added words in
    the second. Ties go to the entry with more pairs of neighbouring characters in common, then to the
    smaller ref_id; entries of one form are one entry. Empty and blank values and those without letters
    or digits are unmatched.
    """
    rows = references.where(F.col("entry").isNotNull()).select("list", F.col("ref_id").cast("bigint").alias("ref_id"), F.col("entry").cast("string").alias("value"))
    folded = rows.join(distinct_forms(rows.select("list", "value")), ["list", "value"]).where(F.length("form") > 0)
    # The lists, the forms, the plain hits and the result are cut off one by one, so that no plan holds them all.
    entries = cut(folded.groupBy("list", F.col("form").alias("entry")).agg(F.min("ref_id").alias("ref_id")))
    forms = cut(distinct_forms(values))
    held = cut(holding(forms, entries))
    rest = forms.join(held.select("list", "value"), ["list", "value"], "left_anti").where(F.length("form") > 0)
    similar = similar_entries(strip_affixes(rest, learn_affixes(held)), entries, threshold).withColumn("way", F.lit("similar"))
    # An entry within a form shares all its units with it.
    plain = held.select("list", "value", "ref_id", (F.size(_units(F.col("entry"))) / F.size(_units(F.col("form")))).alias("jaccard"), F.lit("holds").alias("way"))
    found = forms.select("list", "value").join(plain.unionByName(similar), ["list", "value"], "left")
    return cut(found.select("list", "value", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"), "jaccard", "way"))


def map_values(values: DataFrame, reference: DataFrame, entry: str, ref_id: str = "ref_id", threshold: float = THRESHOLD) -> DataFrame:
    """map_lists of one list: (value, ref_id, jaccard, way) of a one-column table named value."""
    one = reference.select(F.lit("").alias("list"), F.col(ref_id).alias("ref_id"), F.col(entry).alias("entry"))
    return map_lists(values.select(F.lit("").alias("list"), F.col("value").cast("string").alias("value")), one, threshold).drop("list")


def free_values(parts: list[tuple[DataFrame, str, str, str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(list, field, record_id, value) of the values that aren't literally entries, and the lists (list, ref_id, entry).

    parts has (table, id column, value column, field name, reference table, entry column) of each field;
    fields with one entry column share a list.
    """
    lists: dict[str, DataFrame] = {}
    rows = None
    for df, record_id, column, field, reference, entry in parts:
        lists.setdefault(entry, reference.select(F.lit(entry).alias("list"), F.col("ref_id").cast("bigint").alias("ref_id"), F.col(entry).cast("string").alias("entry")))
        one = df.select(F.lit(entry).alias("list"), F.lit(field).alias("field"), F.col(record_id).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    references = None
    for one in lists.values():
        references = one if references is None else references.unionByName(one)
    exact = references.where(F.col("entry").isNotNull()).select("list", F.col("entry").alias("value")).distinct()
    return rows.where(F.col("value").isNotNull()).join(exact, ["list", "value"], "left_anti"), references


def map_fields(parts: list[tuple[DataFrame, str, str, str, DataFrame, str]]) -> DataFrame:
    """(field, record_id, ref_id) for each record whose non-null value isn't literally an entry; parts as in free_values.

    Distinct values are mapped together. Records with entries written exactly, usually the hot values,
    leave before the join; the rest join on the value, where Spark splits a value that many records share.
    """
    free, references = free_values(parts)
    mapped = map_lists(free.select("list", "value"), references)
    return free.join(mapped.select("list", "value", "ref_id"), ["list", "value"]).select("field", "record_id", "ref_id")


def unmatched_values(parts: list[tuple[DataFrame, str, str, str, DataFrame, str]]) -> DataFrame:
    """(field, value, records): each value that means no entry of its list, with how many records have it."""
    free, references = free_values(parts)
    none = map_lists(free.select("list", "value"), references).where("ref_id = -1")
    return free.groupBy("list", "field", "value").agg(F.count("*").alias("records")).join(none.select("list", "value"), ["list", "value"]).select("field", "value", "records")
