"""Quantities in different units: parse numbers and unit expressions, convert to a canonical unit.

A unit is an exponent vector over base dimensions with a scale and an offset, so products,
quotients and affine units (temperatures) convert by the same rule. The pay grammar reads the
notations of postings: amounts with magnitude words, ranges, open ranges, pay periods and
"N monthly pays a year".
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import Memo, batches

#: Base dimensions, in the order of the exponent vectors.
DIMENSIONS = ("money", "time", "length", "mass", "temperature")


@dataclass(frozen=True)
class Unit:
    """value_in_base = (value + offset) * scale; exponents follow DIMENSIONS."""

    exponents: tuple[int, ...]
    scale: Fraction
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.exponents, other.exponents)), self.scale * other.scale)

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(tuple(a - b for a, b in zip(self.exponents, other.exponents)), self.scale / other.scale)

    def __pow__(self, n: int) -> Unit:
        return Unit(tuple(a * n for a in self.exponents), self.scale**n)


def base(dimension: str, scale: Fraction | int = 1, offset: Fraction | int = 0) -> Unit:
    return Unit(tuple(int(d == dimension) for d in DIMENSIONS), Fraction(scale), Fraction(offset))


def convert(value: Fraction | int, source: Unit, target: Unit) -> Fraction:
    """Exact conversion; ValueError when the dimensions differ."""
    if source.exponents != target.exponents:
        raise ValueError(f"units of different dimensions: {source.exponents}, {target.exponents}")
    return (Fraction(value) + source.offset) * source.scale / target.scale - target.offset


# A year has 12 months or 52 weeks, a month 21.75 days, a day 8 hours (time in months).
MONTH = base("time")
PERIODS = {
    "year": base("time", 12),
    "month": MONTH,
    "week": base("time", Fraction(12, 52)),
    "fortnight": base("time", Fraction(24, 52)),
    "day": base("time", Fraction(4, 87)),
    "hour": base("time", Fraction(4, 87) / 8),
}
YUAN = base("money")
MAGNITUDES = {"千": 1000, "k": 1000, "万": 10000, "w": 10000, "亿": 10**8}
TARGET = YUAN / MONTH

#: Units for parse_unit: names of the plain units of other dimensions.
UNITS = {
    "元": YUAN, "yuan": YUAN, "rmb": YUAN, "月": MONTH, "month": MONTH, "年": PERIODS["year"], "year": PERIODS["year"],
    "周": PERIODS["week"], "week": PERIODS["week"], "天": PERIODS["day"], "日": PERIODS["day"], "day": PERIODS["day"],
    "小时": PERIODS["hour"], "hour": PERIODS["hour"], "h": PERIODS["hour"], "min": PERIODS["hour"] * Unit((0,) * len(DIMENSIONS), Fraction(1, 60)),
    "s": PERIODS["hour"] * Unit((0,) * len(DIMENSIONS), Fraction(1, 3600)),
    "m": base("length"), "cm": base("length", Fraction(1, 100)), "km": base("length", 1000),
    "kg": base("mass"), "g": base("mass", Fraction(1, 1000)), "t": base("mass", 1000),
    "K": base("temperature"), "°C": base("temperature", 1, Fraction(27315, 100)), "°F": base("temperature", Fraction(5, 9), Fraction(45967, 100)),
}


def parse_unit(text: str) -> Unit:
    """A unit expression such as 元/月, km/h or kg*m^2; KeyError for an unknown name."""
    out, sign = None, 1
    for part in re.split(r"([*/·])", text.replace(" ", "")):
        if part in "*/·":
            sign = -1 if part == "/" else 1
            continue
        name, _, power = part.partition("^")
        unit = UNITS[name] ** (sign * int(power or 1)) if power or sign < 0 else UNITS[name]
        out = unit if out is None else out * unit
    return out


_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_TEN = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 10**8}


def chinese_number(text: str) -> tuple[Fraction, int] | None:
    """Value of a Chinese numeral and its last magnitude; 一万四 is 14000, a bare 六 has magnitude 1."""
    total = section = Fraction(0)
    digit, last = None, 1
    for c in text:
        if c in _DIGIT:
            if digit is not None:
                return None
            digit = _DIGIT[c]
            if c in "零〇":
                digit, last = None, 1
        else:
            unit = _TEN[c]
            if unit < 10000:
                section += (1 if digit is None else digit) * unit
            else:
                total = (total + section + (digit or 0)) * unit if section or digit or total else Fraction(unit)
                section = Fraction(0)
            digit, last = None, unit
    if digit is not None:
        section += digit * (last // 10 if last > 10 else 1)
    value = total + section
    return value, max((_TEN[c] for c in text if c in _TEN and _TEN[c] >= 1000), default=1)


# Grammar of pay. Order matters: the longest notation of a place comes first.
_TOKENS = [
    ("pays", r"(?P<pays>\d{1,2})\s*(?:[-~至到]\s*(?P<most>\d{1,2})\s*)?薪"),
    ("year", r"年薪|年包|每年|per\s*year|/\s*year|/\s*年|p\.?a\.?|annually|annual|yearly|year|年"),
    ("month", r"月薪|每月|每个月|per\s*month|/\s*month|/\s*月|monthly|month|月"),
    ("fortnight", r"双周薪|每双周|每两周|/\s*双周|/\s*两周|biweekly|fortnightly|fortnight|双周|两周"),
    ("week", r"周薪|每周|每星期|per\s*week|/\s*week|/\s*周|weekly|week|周"),
    ("hour", r"时薪|每小时|每时|per\s*hour|/\s*hour|/\s*小时|/\s*时|/\s*h(?![a-z])|hourly|hour|小时|时"),
    ("day", r"日薪|每天|每日|per\s*day|/\s*day|/\s*天|/\s*日|daily|day|天|日"),
    ("mixed", r"(?P<whole>\d+)\s*(?P<large>[千万kw])(?P<rest>\d(?:\.\d+)?|\d{3,4}(?=[元块]|$))(?P<small>[千百k])?(?![\d.万千kw])"),
    ("num", r"(?P<num>\d+(?:\.\d+)?)\s*(?P<mag>[千万亿kw](?![a-z]))?"),
    ("cnum", r"(?P<cnum>[零〇一二两三四五六七八九十百千万亿]+)"),
    ("min", r"以上|不低于|不少于|至少|起|from|min"),
    ("max", r"以内|以下|封顶|不超过|不高于|至多|up\s*to|max"),
    ("range", r"--?|~|—+|–|―|‒|至|到|to"),
    ("money", r"人民币|元|块|rmb|cny|yuan|¥|￥"),
    ("skip", r"税前|税后|左右|薪资|工资|底薪|薪酬|待遇|约|[\s()\[\]·*,、/。;:+]"),
]
#: An amount, a comma or bracket, and words without Arabic numerals.
_REMARK = re.compile(r"([^,;。(]+)[,;。(]\D*$")
_TOKEN = re.compile("|".join(f"(?P<t_{name}>{pattern})" for name, pattern in _TOKENS))
_NAMES = [name for name, _ in _TOKENS]


def _lex(text: str) -> list[tuple[str, re.Match]] | None:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        out.append((m.lastgroup[2:] if m.lastgroup.startswith("t_") else next(n for n in _NAMES if m["t_" + n] is not None), m))
        at = m.end()
    return out


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower().strip()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)


def parse_period(text: str | None) -> tuple[str | None, int | None]:
    """Period name and number of pays a year stated by a period text; None for what it does not state."""
    if text is None:
        return None, None
    period = pays = None
    for name, m in _lex(_plain(text)) or []:
        if name == "pays":
            pays = int(m["pays"])
        elif name in PERIODS and period is None:
            period = name
    return period, pays


def _mixed(m: re.Match) -> Fraction:
    """Value of an amount such as 1万5, 1万5千 or 1万5000; without a unit of its own the rest is tenths of the unit before."""
    large = MAGNITUDES[m["large"]]
    small = {"百": 100, "千": 1000, "k": 1000}.get(m["small"] or "", large // 10 if len(m["rest"]) < 3 else 1)
    return int(m["whole"]) * large + Fraction(m["rest"]) * small


def _round(x: Fraction) -> int:
    return int((x + Fraction(1, 2)) // 1)


def parse_pay(text: str | None, period_text: str | None = None) -> tuple[int | None, int | None]:
    """Low and high bound in yuan a month; None for a bound that the text does not state.

    Null, empty and blank texts, texts without an amount, and texts with any word that is no part of
    the grammar state nothing, but for a remark without numbers after a comma. One amount is both
    bounds; an amount with "from" or "up to" is one.
    """
    if text is None:
        return None, None
    plain = _plain(text)
    tokens = _lex(plain)
    if tokens is None and (remark := _REMARK.match(plain)):
        # A remark without numbers may follow an amount that names its unit.
        tokens = _lex(remark[1])
        if tokens and not any(name in ("money", "mixed") or name == "num" and m["mag"] or name == "cnum" for name, m in tokens):
            return None, None
    if not tokens:
        return None, None
    most = None
    period, pays, side = None, None, None
    amounts: list[tuple[Fraction, int | None]] = []
    ranged = False
    for name, m in tokens:
        if name == "num":
            amounts.append((Fraction(m["num"]), MAGNITUDES[m["mag"]] if m["mag"] else None))
        elif name == "cnum":
            read = chinese_number(m["cnum"])
            if read is None:
                return None, None
            value, last = read
            amounts.append((value / last, last) if last > 1 else (value, None))
        elif name == "mixed":
            amounts.append((_mixed(m), 1))
        elif name == "pays":
            pays, most = int(m["pays"]), m["most"] and int(m["most"])
        elif name in PERIODS:
            period = period or name
        elif name in ("min", "max"):
            side = name
        elif name == "range" and len(amounts) == 1:
            ranged = True
    if not amounts or len(amounts) > 2 or (len(amounts) == 2 and not ranged):
        return None, None
    other_period, other_pays = parse_period(period_text)
    period = period or other_period or "month"
    pays = pays or other_pays
    shared = next((unit for _, unit in reversed(amounts) if unit), 1)
    unit = YUAN / PERIODS[period]
    yuan = sorted(convert(value * (own or shared), unit, TARGET) for value, own in amounts)
    # Of a range of pays a year the fewer go with the low bound.
    few, many = [Fraction(n, 12) if n and period != "year" else Fraction(1) for n in (pays, most or pays)]
    low, high = _round(yuan[0] * few), _round(yuan[-1] * many)
    return (None if side == "max" and len(yuan) == 1 else low), (None if side == "min" and len(yuan) == 1 else high)


def normalize_pay(df: DataFrame, record_id: str, amount: str, period: str | None = None, field: str = "pay", bounds: tuple[str, ...] = ("low", "high")) -> DataFrame:
    """One row (field, record_id, bound, yuan_month) for each bound that the amount text states.

    Null amounts, and texts that are no pay, give no row; other columns of df play no part. Each
    distinct pair of texts of a batch is parsed once. An empty table gives an empty result.
    """
    schema = "field string, record_id bigint, bound string, yuan_month bigint"
    wanted = tuple(bounds)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda pair: parse_pay(*pair))
        for batch in batches(rows):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            periods = batch.column(2).to_pylist()
            read = [memo[pair] for pair in zip(texts, periods)]
            for at, name in enumerate(("low", "high")):
                if name not in wanted:
                    continue
                keep = [i for i, pair in enumerate(read) if pair[at] is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * len(keep), pa.string()), pa.array(ids[keep].astype(np.int64)), pa.array([name] * len(keep), pa.string()), pa.array([read[i][at] for i in keep], pa.int64())],
                    ["field", "record_id", "bound", "yuan_month"],
                )

    source = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(amount).cast("string").alias("amount"), (F.col(period).cast("string") if period else F.lit(None).cast("string")).alias("period"))
    return source.where(F.col("amount").isNotNull() & F.col("id").isNotNull()).mapInArrow(run, schema)
