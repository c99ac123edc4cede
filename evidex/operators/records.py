"""Model output to records, by native columns.

JSON is read as a variant whose members are asked for by table; text that holds no JSON becomes an
array of (label, value) lines, of which each field takes the first. Nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.dictionaries import LIST_FIELDS, PAY_KEYS, REQUIRED_KEYS, SCALAR_FIELDS, SKILL_KEYS
from evidex.functions.text import EMPTY, clean_items, clean_scalar, let, lookup, split_list, strip

# Accepted names of a JSON record's members and of a line's label, and patterns of pay and period.
MEMBERS = {
    "职位名称": ("职位名称", "岗位名称"), "薪资范围": ("薪资范围", "薪资"), "工作地点": ("工作地点", "地点"), "技能要求": ("技能要求", "技能"),
    "学历要求": ("学历要求", "学历"), "经验要求": ("经验要求", "经验"), "AI相关技术栈要求": ("AI相关技术栈要求", "AI相关技术栈", "AI技术栈"),
}
LABELS = {
    "职位名称": ("职位名称", "岗位名称"), "薪资范围": ("薪资范围", "薪资待遇", "薪资"), "工作地点": ("工作地点", "地点"), "硬技能": ("硬技能",), "软技能": ("软技能",),
    "学历要求": ("学历要求", "学历"), "经验要求": ("经验要求", "工作经验", "经验"), "AI相关技术栈要求": ("AI相关技术栈要求", "AI相关技术栈", "AI技术栈"),
}
PAY_RANGE = r"(?U)(\d+(?:\.\d+)?)\s*(K|k|千|万|元)?\s*[-~－—到至]\s*(\d+(?:\.\d+)?)\s*(K|k|千|万|元)?"
PAY_PERIOD = r"(?U)(1[0-9]薪|/\s*月|每月|元/月|月薪|/\s*年|年薪|/\s*天|元/天|日薪)"
STRAY_COMMA = r"(?U),(\s*[}\]])"

_NAME_OF = {label: name for name, labels in LABELS.items() for label in labels}
# White space may stand between the Latin and the Han letters of a label.
_LABEL = "|".join(re.sub(r"(?<=[A-Z])(?=[^A-Z])", r"\\s*", x) for x in _NAME_OF)
# A labelled line; list marks, a number and emphasis may stand around the label.
_LINE = rf"(?Ud)^\s*(?:[|\-*+•>]+\s*)?(?:\d+[.、)]\s*)?(?:\*\*|[`\s])*({_LABEL})(?:\*\*|[`\s])*[:：](.*)$"
_EMPHASIS = r"\*\*|`"


def whole_json(text: Column) -> Column:
    """The variant of a text that is JSON from end to end, else null; the JSON null is a variant too.

    Spark's parser stops after the first value, so the text is read as the first of two members of an
    array whose second is a hash of the text: what follows the value would displace the hash.
    """
    mark = F.xxhash64(text)
    # A text that starts otherwise than a value does needn't be tried: a failure costs more than a success.
    starts = text.rlike(r"^[ \t\r\n]*[\[{\"0-9tfn-]")
    held = F.when(starts, F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))))
    return let(held, lambda h: F.when(F.try_variant_get(h, "$[1]", "bigint") == mark, F.try_variant_get(h, "$[0]", "variant")))


def inner_json(text: Column) -> Column:
    """The variant of the object between the first and the last brace, with stray commas and curly quotes mended, else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return whole_json(F.translate(F.regexp_replace(body, STRAY_COMMA, "$1"), "“”", '""'))


def json_level(text: Column) -> Column:
    """strict for plain JSON, repaired for JSON within other text, text for neither."""
    return F.when(whole_json(text).isNotNull(), "strict").when(inner_json(text).isNotNull(), "repaired").otherwise("text")


def member(value: Column, *names: str) -> Column:
    """Of several accepted names the first member that is there, null or not."""
    return F.coalesce(*[F.try_variant_get(value, f"$['{n}']", "variant") for n in names])


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID or another type of a variant; null for no variant."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def plain(value: Column) -> Column:
    """A variant as text: a text as it is, anything else in JSON's spelling."""
    return F.try_variant_get(value, "$", "string")


def array_of(value: Column) -> Column:
    """The texts of a variant that is an array, else null."""
    return F.try_variant_get(value, "$", "array<string>")


def listed(value: Column) -> Column:
    """Clean items of a variant: of an array, of a list written as one text, or of one value."""

    def of(x: Column) -> Column:
        one = F.when(kind(x["v"]) == "STRING", split_list(plain(x["v"]))).otherwise(clean_items(F.filter(F.array(plain(x["v"])), lambda y: y.isNotNull())))
        return F.coalesce(F.when(x["a"].isNotNull(), clean_items(F.filter(x["a"], lambda y: y.isNotNull()))).otherwise(one), F.array().cast(EMPTY))

    return let(F.struct(value.alias("v"), array_of(value).alias("a")), of)


def pay_of(text: Column) -> Column:
    """struct(low, high, period) of a pay text; the unit of the upper end, or else the lower, goes with both."""

    def found(s: Column) -> Column:
        low, unit_low, high, unit_high = (F.regexp_extract(s, PAY_RANGE, i) for i in range(1, 5))
        unit = F.coalesce(F.nullif(unit_high, F.lit("")), unit_low)
        sign = F.nullif(F.regexp_extract(s, PAY_PERIOD, 1), F.lit(""))
        period = F.when(F.contains(sign, F.lit("月")), "月").when(F.contains(sign, F.lit("年")), "年").when(sign.rlike("[天日]"), "日").otherwise(sign)
        says = clean_scalar(s).isNotNull()
        ends = [F.when(says & (end != ""), F.concat(end, unit)) for end in (low, high)]
        return F.struct(ends[0].alias("low"), ends[1].alias("high"), F.when(says, period).alias("period"))

    return let(text, found)


def labelled(text: Column) -> Column:
    """Array of struct(name, value): the labelled lines and two-column table rows of a text, in order."""

    def table_row(line: Column) -> Column:
        cells = F.split(F.btrim(strip(line), F.lit("|")), r"\|")
        return F.struct(F.replace(strip(F.get(cells, F.lit(0))), F.lit("**"), F.lit("")).alias("label"), F.replace(strip(F.get(cells, F.lit(1))), F.lit("**"), F.lit("")).alias("value"))

    def labelled_line(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, _LINE, 1).alias("label"), strip(F.regexp_replace(F.regexp_extract(line, _LINE, 2), _EMPHASIS, "")).alias("value"))

    def named(pair: Column) -> Column:
        return F.struct(lookup(F.regexp_replace(pair["label"], r"(?U)(?<=[A-Z])\s+|^\s+|\s+\z", ""), _NAME_OF, F.lit(None).cast("string")).alias("name"), pair["value"].alias("value"))

    def pipes(line: Column) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))

    # Most lines hold no label at all and stay out of the patterns.
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?U){_LABEL}"))
    return F.filter(F.transform(F.transform(lines, lambda x: F.when(pipes(x) >= 2, table_row(x)).otherwise(labelled_line(x))), named), lambda p: p["name"].isNotNull() & p["value"].isNotNull())


def first_of(lines: Column, name: str) -> Column:
    """Value of the first labelled line of a name."""
    return F.get(F.filter(lines, lambda p: p["name"] == name), F.lit(0))["value"]


def schema_errors(value: Column, is_object: Column) -> Column:
    """What a variant lacks of the record schema, as an array of texts; is_object says whether it is an object at all."""

    def lacks(x: Column) -> Column:
        out = [F.when(member(x["v"], k).isNull(), f"missing: {k}") for k in REQUIRED_KEYS]
        out.append(F.when(~x["pay"], "no object: 薪资范围"))
        out += [F.when(x["pay"] & member(x["p"], k).isNull(), f"missing: 薪资范围.{k}") for k in PAY_KEYS]
        out.append(F.when(~x["skills"], "no object: 技能要求"))
        out += [F.when(x["skills"] & array_of(member(x["s"], k)).isNull(), f"no list: {k}") for k in SKILL_KEYS]
        out.append(F.when(array_of(member(x["v"], "AI相关技术栈要求")).isNull(), "no list: AI相关技术栈要求"))
        return F.array_compact(F.array(*out))

    def kinds(x: Column) -> Column:
        pay, skills = (F.coalesce(kind(x[c]) == "OBJECT", F.lit(False)) for c in ("p", "s"))
        return let(F.struct(x["v"].alias("v"), x["p"].alias("p"), x["s"].alias("s"), pay.alias("pay"), skills.alias("skills")), lacks)

    parts = F.struct(value.alias("v"), member(value, "薪资范围").alias("p"), member(value, "技能要求").alias("s"))
    return F.when(is_object, let(parts, kinds)).otherwise(F.array(F.lit("not an object")))


def parse_outputs(df: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """keys, the record's fields, level, json_level, schema_ok and errors of each row's raw text.

    level is strict for plain JSON, repaired for JSON within other text, else text: the fields then
    come from labelled lines. A bare JSON null is strict JSON, but no record. Null raw text is the empty
    text. A repeated member of an object counts by its last value, which the session's setting allows.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.coalesce(F.col(raw).cast("string"), F.lit(""))
    strict = df.select(*keys, text.alias("_text")).select("*", whole_json(F.col("_text")).alias("_whole"))
    # Only a text that isn't JSON is searched for an object.
    read = strict.select("*", F.when(F.col("_whole").isNull(), inner_json(F.col("_text"))).alias("_inner"))
    value = F.coalesce("_whole", "_inner")
    is_record = value.isNotNull() & ~F.is_variant_null(value)
    read = read.select(
        *keys, F.when(is_record, value).alias("_value"), F.when(~is_record, labelled(F.col("_text"))).alias("_lines"),
        F.when(F.col("_whole").isNotNull(), "strict").when(F.col("_inner").isNotNull(), "repaired").otherwise("text").alias("json_level"),
        # What was found within other text is an object; a text that is one value says so by its first character.
        (F.col("_inner").isNotNull() | F.col("_text").rlike(r"^[ \t\r\n]*\{")).alias("_object"),
    )
    v = F.col("_value")
    read = read.select("*", member(v, *MEMBERS["薪资范围"]).alias("_pay"), member(v, *MEMBERS["技能要求"]).alias("_skills"))
    line = {name: first_of(F.col("_lines"), name) for name in LABELS}
    pay_text = F.coalesce(F.when(kind(F.col("_pay")) == "STRING", plain(F.col("_pay"))), line["薪资范围"])
    read = read.select("*", pay_of(pay_text).alias("_range"))
    member_of: dict[str, Column] = {name: member(v, *names) for name, names in MEMBERS.items()}
    member_of |= dict(zip(PAY_KEYS, [member(F.col("_pay"), k) for k in PAY_KEYS]))
    member_of |= {k: F.when(kind(F.col("_skills")) == "OBJECT", member(F.col("_skills"), k)).otherwise(member(v, k)) for k in SKILL_KEYS}
    stated: Mapping[str, Column] = line | dict(zip(PAY_KEYS, [F.col("_range")[c] for c in ("low", "high", "period")]))
    scalars = [clean_scalar(F.coalesce(plain(member_of[f]), stated[f])).alias(f) for f in SCALAR_FIELDS]
    lists = [F.when(v.isNotNull(), listed(member_of[f])).otherwise(split_list(stated[f])).alias(f) for f in LIST_FIELDS]
    errors = F.when(v.isNotNull(), schema_errors(v, F.col("_object"))).otherwise(F.array(F.lit("no JSON")))
    full = read.select(*keys, *scalars, *lists, F.when(v.isNotNull(), F.col("json_level")).otherwise("text").alias("level"), "json_level", errors.alias("errors"))
    return full.select(*keys, *SCALAR_FIELDS, *LIST_FIELDS, "level", "json_level", (F.size("errors") == 0).alias("schema_ok"), "errors")
