"""Queries of record extraction and its evaluation, of provider runs and of event windows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from evidex import dictionaries as D
from evidex.dictionaries import Study
from evidex.functions import text as T
from evidex.functions.register import register
from evidex.operators import extraction as X
from evidex.operators import records
from evidex.plans.core_queries import _NORM_SQL, _TOKENS_SQL, _sql_items, _sql_scalar
from evidex.plans.pipelines import evaluated
from evidex.plans.registry import Registry, table
from evidex.sources import providers
from evidex.streaming import windows

registry = Registry()
query = registry.query


def outputs(spark, sf_dir):
    """Raw model outputs made from the records: lines for v1, fenced JSON with a stray comma for v2, plain JSON for v3."""
    info = table(spark, sf_dir, "jobinfo")
    lists = {c: T.split_list(F.col(c)) for c in D.LIST_FIELDS}
    value = F.struct(
        F.col("职位名称"), F.struct("最低薪资", "最高薪资", "薪资周期").alias("薪资范围"), F.col("工作地点"),
        F.struct(lists["硬技能"].alias("硬技能"), lists["软技能"].alias("软技能")).alias("技能要求"), F.col("学历要求"), F.col("经验要求"), lists["AI相关技术栈要求"].alias("AI相关技术栈要求"),
    )
    text = F.to_json(value, {"ignoreNullFields": "false"})
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace(text, r"\}$", ",}"), F.lit("\n```"))
    lines = F.concat_ws("\n", F.concat(F.lit("1. **职位名称**："), F.coalesce("职位名称", F.lit("未提及"))), F.concat(F.lit("- 学历要求: "), F.coalesce("学历要求", F.lit("无"))), F.concat(F.lit("| 工作地点 | "), F.coalesce("工作地点", F.lit("无")), F.lit(" |")))
    raw = F.when(F.col("version") == "v1", lines).when(F.col("version") == "v2", fenced).otherwise(text)
    return info.select("info_id", "row_id", "sample_id", "run", "version", raw.alias("raw"))


def parsed(spark, sf_dir):
    return records.parse_outputs(outputs(spark, sf_dir), ["info_id", "row_id", "sample_id", "run", "version"], "raw")


_QUOTED = " or ".join(f"contains(coalesce({c}, ''), '{q}')" for c in ("职位名称", "最低薪资", "最高薪资", "薪资周期", "工作地点", "学历要求", "经验要求") for q in "“”")
_QUOTED_LISTS = " or ".join(f"contains(coalesce(array_to_string({_sql_items(c)}, '¦'), ''), '{q}')" for c in D.LIST_FIELDS for q in "“”")
_LEVEL_SQL = f"select *, case version when 'v1' then 'text' when 'v3' then 'strict' else case when {_QUOTED} or {_QUOTED_LISTS} then 'text' else 'repaired' end end as level from jobinfo"


@query("parse_ladder", f"with l as ({_LEVEL_SQL}) select version, level, level <> 'text' as schema_ok, count(*) as n from l group by 1, 2, 3")
def parse_ladder(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("version", "level", "schema_ok").agg(F.count("*").alias("n"))


@query("parse_levels", f"with l as ({_LEVEL_SQL}) select run, count(*) as n, round(avg((level = 'strict')::int), 6) as strict_rate, round(avg((level <> 'text')::int), 6) as json_rate, round(avg((level <> 'text')::int), 6) as schema_rate, count(*) filter (level = 'text') as no_json from l group by 1")
def parse_levels(spark, sf_dir):
    return X.level_counts(parsed(spark, sf_dir), ["run"]).select("run", "n", *[F.round(c, 6).alias(c) for c in ("strict_rate", "json_rate", "schema_rate")], "no_json")


# What each step reads of the outputs: v3 and readable v2 all fields, v1 the labelled lines, unreadable v2 nothing.
_READ_SQL = f"with l as ({_LEVEL_SQL}), r as (select *, level <> 'text' as json, split_part(coalesce(职位名称, '未提及'), chr(10), 1) as line from l)"


@query(
    "parsed_fields",
    _READ_SQL
    + f""" select info_id, case when json then {_sql_scalar('职位名称')} when version = 'v1' then {_sql_scalar("replace(replace(line, '**', ''), '`', '')")} end as title,
    case when json then {_sql_scalar('最低薪资')} end as low, case when json then {_sql_scalar('薪资周期')} end as period,
    case when json then coalesce(array_to_string({_sql_items('软技能')}, '¦'), '') else '' end as soft from r""",
)
def parsed_fields(spark, sf_dir):
    """The fields of the records of all versions, by whichever step read them."""
    p = parsed(spark, sf_dir)
    return p.select("info_id", F.col("职位名称").alias("title"), F.col("最低薪资").alias("low"), F.col("薪资周期").alias("period"), F.array_join("软技能", "¦").alias("soft"))


_EMPTY_OF = {"薪资范围": "OBJECT", "技能要求": "OBJECT", "AI相关技术栈要求": "ARRAY"}
_ERROR_SQL = " union all ".join(
    [f"""select event_id, 'missing: {k}' as error from o where not json_exists(props, '$."{k}"')""" for k in D.REQUIRED_KEYS]
    + [f"""select event_id, '{"no list" if kind == "ARRAY" else "no object"}: {k}' from o where coalesce(json_type(props, '$."{k}"'), '') <> '{kind}'""" for k, kind in _EMPTY_OF.items()]
    + [f"""select event_id, 'missing: 薪资范围.{k}' from o where json_type(props, '$."薪资范围"') = 'OBJECT' and not json_exists(props, '$."薪资范围"."{k}"')""" for k in D.PAY_KEYS]
    + [f"""select event_id, 'no list: {k}' from o where json_type(props, '$."技能要求"') = 'OBJECT' and coalesce(json_type(props, '$."技能要求"."{k}"'), '') <> 'ARRAY'""" for k in D.SKILL_KEYS]
    + ["select event_id, 'not an object' from events where json_valid(props) and json_type(props) <> 'OBJECT'", "select event_id, 'no JSON' from events where not coalesce(json_valid(props), false)"]
)


@query("schema_errors", f"with o as (select event_id, props from events where json_valid(props) and json_type(props) = 'OBJECT'), e as ({_ERROR_SQL}) select error, count(*) as n from e group by 1")
def schema_errors(spark, sf_dir):
    """How often each part of the schema is missing in the events' properties read as records."""
    props = table(spark, sf_dir, "events").select("event_id", "props")
    p = records.parse_outputs(props, ["event_id"], "props")
    return p.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("json_field_parse", "select event_id, (props ->> '$.k')::int as k from events")
def json_field_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("sql_functions", "select event_id, case when json_valid(props) then 'strict' else 'text' end as level, upper(event_type) as kind from events")
def sql_functions(spark, sf_dir):
    """The registered functions from SQL text."""
    register(spark)
    return spark.sql(f"select event_id, evidex_json_level(props) as level, upper(evidex_nfkc(event_type)) as kind from parquet.`{sf_dir}/events.parquet`")


_SPACES = "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$"
_RANGE_RE = "(\\p{Nd}+(?:\\.\\p{Nd}+)?)[\\s\\p{Z}]*(K|k|千|万|元)?[\\s\\p{Z}]*[-~－—到至][\\s\\p{Z}]*(\\p{Nd}+(?:\\.\\p{Nd}+)?)[\\s\\p{Z}]*(K|k|千|万|元)?"
_PERIOD_RE = "(1[0-9]薪|/[\\s\\p{Z}]*月|每月|元/月|月薪|/[\\s\\p{Z}]*年|年薪|/[\\s\\p{Z}]*天|元/天|日薪)"


def _pay_ends_sql(x: str) -> str:
    """low, high and period of a pay text, for a select list."""
    part = [f"regexp_extract({x}, '{_RANGE_RE}', {i})" for i in range(1, 5)]
    unit = f"coalesce(nullif({part[3]}, ''), {part[1]})"
    sign = f"nullif(regexp_extract({x}, '{_PERIOD_RE}', 1), '')"
    period = f"case when contains({sign}, '月') then '月' when contains({sign}, '年') then '年' when contains({sign}, '天') or contains({sign}, '日') then '日' else {sign} end"
    says = f"{_sql_scalar(x)} is not null"
    return f"case when {says} then nullif({part[0]}, '') || {unit} end as low, case when {says} then nullif({part[2]}, '') || {unit} end as high, case when {says} then {period} end as period"


@query(
    "pay_text_parts",
    f"""with x as (select row_id, split_part(coalesce(salary, ''), chr(10), 1) as line from company_jobs_merged),
    y as (select row_id, case when length(line) - length(replace(line, '|', '')) < 2 then regexp_replace(replace(replace(line, '**', ''), '`', ''), '{_SPACES}', '', 'g') end as t from x)
    select row_id, {_pay_ends_sql("t")} from y""",
)
def pay_text_parts(spark, sf_dir):
    """Low, high and period that record texts state, by the pay pattern of free output."""
    lines = table(spark, sf_dir, "company_jobs_merged").select("row_id", F.concat(F.lit("薪资范围："), F.coalesce("salary", F.lit(""))).alias("t"))
    p = records.parse_outputs(lines, ["row_id"], "t")
    return p.select("row_id", F.col("最低薪资").alias("low"), F.col("最高薪资").alias("high"), F.col("薪资周期").alias("period"))


_SCALARS = [("职位名称", "title"), ("学历要求", "degree"), ("经验要求", "experience")]


def clean_records(spark, sf_dir):
    """The records as the table states them, with all fields cleaned."""
    info = table(spark, sf_dir, "jobinfo")
    return info.select("info_id", "row_id", "version", *[T.clean_scalar(F.col(c)).alias(c) for c in D.SCALAR_FIELDS], *[T.split_list(F.col(c)).alias(c) for c in D.LIST_FIELDS])


def unit_rows(spark, sf_dir):
    return X.units(clean_records(spark, sf_dir), ["info_id", "row_id", "version"])


def _units_of_sql(source: str, scalars: dict[str, str], lists: dict[str, str]) -> str:
    """CTEs up to v (info_id, row_id, version, field, unit) of a source, by SQL of each field."""
    parts = [f"select info_id, row_id, version, '{f}' as field, {x} as unit from {source}" for f, x in scalars.items()]
    parts += [f"select info_id, row_id, version, '{f}', unnest({x}) from {source}" for f, x in lists.items()]
    return f"u as ({' union all '.join(parts)}), v as (select * from u where unit is not null and unit <> '')"


_UNITS_SQL = "with " + _units_of_sql("jobinfo", {c: _sql_scalar(c) for c in D.SCALAR_FIELDS}, {c: _sql_items(c) for c in D.LIST_FIELDS})


@query("units_explode", _UNITS_SQL + " select version, field, count(*) as n, count(distinct unit) as kinds from v group by 1, 2")
def units_explode(spark, sf_dir):
    return unit_rows(spark, sf_dir).groupBy("version", "field").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("kinds"))


def _nfkc_parts() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with a one-letter compatibility form, these forms, and pairs of those whose form is longer."""
    single: list[tuple[str, str]] = []
    several: list[tuple[str, str]] = []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        form = unicodedata.normalize("NFKC", c)
        if form != unicodedata.normalize("NFC", c):
            if len(form) == 1:
                single.append((c, form))
            elif ord(c) < 0x3400:
                several.append((c, form))
    return "".join(a for a, _ in single), "".join(b for _, b in single).replace("'", "''"), [(a, b.replace("'", "''")) for a, b in several]


_FROM, _TO, _LONGER = _nfkc_parts()


def _nfkc_sql(x: str) -> str:
    """Compatibility form of Unicode in DuckDB, by tables; longer forms from U+3400 on are left out."""
    out = f"translate({x}, '{_FROM}', '{_TO}')"
    longer = out
    for a, b in _LONGER:
        longer = f"replace({longer}, '{a}', '{b}')"
    return f"nfc_normalize(case when not regexp_matches({x}, '[^ -~一-鿿]') then {x} when regexp_matches({x}, '[{''.join(a for a, _ in _LONGER)}]') then {longer} else {out} end)"


def _norm_wide(x: str) -> str:
    return _NORM_SQL.format(_nfkc_sql(x))


def _judged_sql(units: str, source: str) -> str:
    """CTEs up to j: units of v with whether the source of their posting holds one of their forms."""
    digits = "case when field in ('最低薪资', '最高薪资') then regexp_replace(unit, '[^0-9.]', '', 'g') else '' end"
    forms = f"list_filter([bare, {digits}, case when field = '薪资周期' then bare || '薪' else '' end, case when field = '薪资周期' then '元' || bare else '' end], lambda x: x <> '')"
    return (
        units
        + f""", kinds as (select unit, {_norm_wide('unit')} as bare from (select distinct unit from v)),
        src as (select row_id, {_norm_wide(source)} as s from company_jobs_merged),
        j as (select v.*, len(list_filter({forms}, lambda x: contains(coalesce(s, ''), x))) > 0 and s is not null as supported from v join kinds using (unit) left join src using (row_id))"""
    )


def _joined(*columns: str) -> str:
    return f"concat_ws(chr(10), {', '.join(columns)})"


_JUDGED_SQL = _judged_sql(_UNITS_SQL, _joined("title", "jd"))


def judged(spark, sf_dir):
    """All units of the records, judged by the literal evidence of their posting."""
    posts = table(spark, sf_dir, "company_jobs_merged").select("row_id", F.concat_ws("\n", "title", "jd").alias("input_text"))
    return X.verdicts(unit_rows(spark, sf_dir), posts, ["row_id"], "input_text")


@query("evidence_containment", _JUDGED_SQL + " select field, supported, count(*) as n from j group by 1, 2")
def evidence_containment(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("field", "supported").agg(F.count("*").alias("n"))


@query(
    "hallucination_rates",
    _JUDGED_SQL + """, s as (select version, info_id, count(*) as units, count(*) filter (not supported) as bad from j group by 1, 2)
    select version, sum(units)::bigint as units, sum(bad)::bigint as bad_units, round(sum(bad)::double / sum(units), 6) as unit_rate, round(avg((bad > 0)::int), 6) as sample_rate from s group by 1""",
)
def hallucination_rates(spark, sf_dir):
    h = X.hallucination(judged(spark, sf_dir), ["version"], "info_id")
    return h.select("version", "units", "bad_units", F.round("unit_rate", 6).alias("unit_rate"), F.round("sample_rate", 6).alias("sample_rate"))


@query("flag_queue", _JUDGED_SQL + " select row_id, unit, array_to_string(list_sort(list_distinct(list(version || '/' || field))), ',') as seen from j where not supported and row_id is not null group by 1, 2")
def flag_queue(spark, sf_dir):
    return X.screening_queue(judged(spark, sf_dir).where("row_id is not null"), "row_id", "version").select("row_id", "unit", F.array_join("seen", ",").alias("seen"))


def _bare_line(c: str, empty: str) -> str:
    return f"replace(replace(split_part(coalesce({c}, '{empty}'), chr(10), 1), '**', ''), '`', '')"


# What the labelled lines of v1 state; the place stands in a table row.
_LINE_OF = {"职位名称": _bare_line("职位名称", "未提及"), "学历要求": _bare_line("学历要求", "无"), "工作地点": "replace(split_part(split_part(coalesce(工作地点, '无'), chr(10), 1), '|', 1), '**', '')"}


def _read_scalar(c: str) -> str:
    line = f" when version = 'v1' then {_sql_scalar(_LINE_OF[c])}" if c in _LINE_OF else ""
    return f"case when json then {_sql_scalar(c)}{line} end"


def _read_items(c: str) -> str:
    return f"case when json then coalesce({_sql_items(c)}, []) else [] end"


_READ_UNITS_SQL = _READ_SQL + ", " + _units_of_sql("r", {c: _read_scalar(c) for c in D.SCALAR_FIELDS}, {c: _read_items(c) for c in D.LIST_FIELDS})


@query("literal_evidence", _judged_sql(_READ_UNITS_SQL, _joined("title", "salary", "location", "jd")) + " select version, field, count(*) as n, count(*) filter (supported) as supported from j where row_id is not null group by 1, 2")
def literal_evidence(spark, sf_dir):
    """Units judged by all literal forms, digits of pay and period variants included."""
    posts = table(spark, sf_dir, "company_jobs_merged").select("row_id", F.concat_ws("\n", "title", "salary", "location", "jd").alias("input_text"))
    p = parsed(spark, sf_dir).where("row_id is not null")
    rows = X.units(p, ["info_id", "row_id", "version"])
    v = X.verdicts(rows, posts, ["row_id"], "input_text")
    return v.groupBy("version", "field").agg(F.count("*").alias("n"), F.count_if("supported").alias("supported"))


def _sets_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '[,，;；、|/\\t\\n]'), lambda x: trim(x)), lambda x: x <> '')))"


def _sets(c: str):
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[,，;；、|/\\t\\n]"), lambda x: F.trim(x)), lambda x: x != "")))


_PRF_SQL = f"""
    with s as (select info_id, version, {_sets_sql('i.硬技能')} as p, {_sets_sql('j.skills')} as g from jobinfo i join company_jobs_merged j using (row_id)),
    c as (select info_id, version, len(list_intersect(p, g)) as tp, len(p) - len(list_intersect(p, g)) as fp, len(g) - len(list_intersect(p, g)) as fn from s),
    f as (select *, case when tp + fp + fn = 0 then 1 when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn)::double end as f1 from c)
"""


def prf_rows(spark, sf_dir):
    info, jobs = table(spark, sf_dir, "jobinfo"), table(spark, sf_dir, "company_jobs_merged")
    s = info.select("info_id", "row_id", "version", _sets("硬技能").alias("p")).join(jobs.select("row_id", _sets("skills").alias("g")), "row_id")
    return s.select("info_id", "version", *[c.alias(n) for n, c in X.set_scores(F.col("p"), F.col("g")).items()])


@query("set_prf", _PRF_SQL + "select info_id, tp, fp, fn, round(f1, 6) as f1 from f")
def set_prf(spark, sf_dir):
    return prf_rows(spark, sf_dir).select("info_id", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("list_metrics", _PRF_SQL + "select version, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, round(avg(f1), 6) as macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::double, 6) as micro_f1 from f group by 1")
def list_metrics(spark, sf_dir):
    return X.list_metrics(prf_rows(spark, sf_dir), ["version"]).select("version", "tp", "fp", "fn", F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


# Right fields: scalars by comparison form, lists by their sets of forms.
_RESULTS_SQL = (
    ", sv as ("
    + " union all ".join(f"select info_id, version, '{c}' as field, {_read_scalar(c)} as pred, {_sql_scalar(c)} as gold from r" for c in D.SCALAR_FIELDS)
    + f"), sk as (select x, {_norm_wide('x')} as bare from (select pred as x from sv union select gold from sv) where x is not null), "
    + "sr as (select info_id, version, field, case when gold is null then pred is null else coalesce(p.bare = g.bare, false) end as ok from sv left join sk p on p.x = pred left join sk g on g.x = gold), lv as ("
    + " union all ".join(f"select info_id, version, '{c}' as field, {side} as side, unnest({x}) as x from r" for c in D.LIST_FIELDS for side, x in (("'p'", _read_items(c)), ("'g'", f"coalesce({_sql_items(c)}, [])")))
    + f"), lk as (select x, {_norm_wide('x')} as bare from (select distinct x from lv)), ls as (select distinct info_id, version, field, side, bare from lv join lk using (x) where bare <> ''), "
    + "lc as (select info_id, version, field, count(*) filter (sides = 2) as tp, count(*) filter (sides = 1 and one = 'p') as fp, count(*) filter (sides = 1 and one = 'g') as fn from (select info_id, version, field, bare, count(*) as sides, min(side) as one from ls group by 1, 2, 3, 4) group by 1, 2, 3), "
    + f"la as (select info_id, version, f.field, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from r cross join (select unnest({D.LIST_FIELDS!r}::varchar[]) as field) f left join lc using (info_id, version, field)), ".replace(repr(D.LIST_FIELDS), "[" + ", ".join(f"'{c}'" for c in D.LIST_FIELDS) + "]")
    + "results as (select info_id, version, field, ok, ok as lenient from sr union all select info_id, version, field, fp + fn = 0, case when tp + fp + fn = 0 then true else 2 * tp / (2 * tp + fp + fn)::double >= 0.8 end from la)"
)


@query("field_accuracy", _READ_SQL + _RESULTS_SQL + " select version, field, round(avg(ok::int), 6) as strict, round(avg(lenient::int), 6) as lenient, count(*) as n from results group by 1, 2")
def field_accuracy(spark, sf_dir):
    """Accuracy by version and field of the parsed outputs against the records that they were made from."""
    info = table(spark, sf_dir, "jobinfo")
    gold = info.select("info_id", *[T.clean_scalar(F.col(c)).alias(c) for c in D.SCALAR_FIELDS], *[T.split_list(F.col(c)).alias(c) for c in D.LIST_FIELDS])
    a = X.accuracy(X.field_results(parsed(spark, sf_dir), gold, ["info_id"], ["version"]), ["version", "field"])
    return a.select("version", "field", *[F.round(c, 6).alias(c) for c in ("strict", "lenient")], "n")


@query(
    "pipeline_evaluation",
    _judged_sql(_READ_UNITS_SQL, _joined("title", "salary", "location", "skills", "jd")) + _RESULTS_SQL
    + """, le as (select version, count(*) as n, round(avg((level = 'strict')::int), 6) as strict_rate, round(avg((level <> 'text')::int), 6) as json_rate, round(avg((level <> 'text')::int), 6) as schema_rate, count(*) filter (level = 'text') as no_json from l group by 1),
    ac as (select version, round(avg(ok::int), 6) as strict, round(avg(lenient::int), 6) as lenient from results group by 1),
    hs as (select version, info_id, count(*) as units, count(*) filter (not supported) as bad from j group by 1, 2),
    ha as (select version, sum(units)::bigint as units, sum(bad)::bigint as bad_units, round(sum(bad)::double / sum(units), 6) as unit_rate, round(avg((bad > 0)::int), 6) as sample_rate from hs group by 1)
    select * from le join ac using (version) join ha using (version)""",
)
def pipeline_evaluation(spark, sf_dir):
    """The whole evaluation of the outputs against the records, with the postings as sources: one row a version."""
    info = table(spark, sf_dir, "jobinfo")
    gold = info.select("info_id", *[T.clean_scalar(F.col(c)).alias(c) for c in D.SCALAR_FIELDS], *[T.split_list(F.col(c)).alias(c) for c in D.LIST_FIELDS])
    posts = table(spark, sf_dir, "company_jobs_merged").select("row_id", F.concat_ws("\n", "title", "salary", "location", "skills", "jd").alias("input_text"))
    samples = info.select("info_id", "row_id").join(posts, "row_id").select("info_id", "input_text")
    out = evaluated(outputs(spark, sf_dir).select("version", "info_id", "raw"), gold, samples, Study(), key="info_id")
    rates = ("strict_rate", "json_rate", "schema_rate", "strict", "lenient", "unit_rate", "sample_rate")
    joined = out["levels"].join(out["accuracy"].select("version", "strict", "lenient"), "version").join(out["hallucination"], "version")
    return joined.select(*[F.round(c, 6).alias(c) if c in rates else c for c in joined.columns])


@query(
    "label_accuracy",
    """
    select kind, count(*) as n, round(avg(((length(text) - length(replace(text, chr(10), ''))) * 30 > length(text))::int), 6) as many_lines
    from doc_labels join documents using (doc_id) where text is not null group by 1
    """,
)
def label_accuracy(spark, sf_dir):
    joined = table(spark, sf_dir, "doc_labels").join(table(spark, sf_dir, "documents"), "doc_id").where("text is not null")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg((lines * 30 > F.length("text")).cast("int")), 6).alias("many_lines"))


def signatures(spark, sf_dir):
    info = table(spark, sf_dir, "jobinfo").select("info_id", "sample_id", "run")
    return X.record_signatures(clean_records(spark, sf_dir).join(info, "info_id"), ["version", "sample_id", "run", "info_id"])


_SIGN_SQL = (
    "with sv as ("
    + " union all ".join(f"select sample_id, version, '{c}' as field, {_sql_scalar(c)} as x from jobinfo" for c in D.SCALAR_FIELDS)
    + f"), sk as (select x, {_norm_wide('x')} as bare from (select distinct x from sv) where x is not null), lv as ("
    + " union all ".join(f"select info_id, sample_id, version, '{c}' as field, unnest(case when len(coalesce({_sql_items(c)}, [])) = 0 then [''] else {_sql_items(c)} end) as x from jobinfo" for c in D.LIST_FIELDS)
    + f"), lk as (select x, {_norm_wide('x')} as bare from (select distinct x from lv)), "
    + "s as (select sample_id, version, field, coalesce(bare, '') as signature from sv left join sk using (x) union all "
    + "select sample_id, version, field, coalesce(array_to_string(list_sort(list_distinct(list(bare) filter (bare <> ''))), '|'), '') from lv join lk using (x) group by info_id, sample_id, version, field), "
    + "k as (select version, sample_id, field, count(distinct signature) as k from s group by 1, 2, 3)"
)


@query("consistency_rate", _SIGN_SQL + " select version, count(*) filter (k = 1) as same, count(*) as n, round(avg((k = 1)::int), 6) as rate from k group by 1")
def consistency_rate(spark, sf_dir):
    return X.consistency(signatures(spark, sf_dir), ["version"], ["sample_id", "field"]).select("version", "same", "n", F.round("rate", 6).alias("rate"))


@query("drift_list", _SIGN_SQL + " select version, sample_id, field from k where k > 1")
def drift_list(spark, sf_dir):
    return X.drift(signatures(spark, sf_dir), ["version"], ["sample_id", "field"])


@query("call_costs", f"select version, round(avg({_TOKENS_SQL.format('p')}), 6) as tokens_in, round(avg({_TOKENS_SQL.format('o')}), 6) as tokens_out from (select version, '提取：' || coalesce(jd, '') as p, coalesce(硬技能, '') as o from jobinfo join company_jobs_merged using (row_id)) group by 1")
def call_costs(spark, sf_dir):
    joined = table(spark, sf_dir, "jobinfo").join(table(spark, sf_dir, "company_jobs_merged").select("row_id", "jd"), "row_id")
    prompt = T.fill_template("提取：{job_description}", F.coalesce("jd", F.lit("")))
    return X.costs(joined, ["version"], prompt, F.coalesce("硬技能", F.lit(""))).select("version", F.round("tokens_in", 6).alias("tokens_in"), F.round("tokens_out", 6).alias("tokens_out"))


@query(
    "wilson_ci",
    """
    with g as (select annotator, count(*) filter (kind = 'prose') as hits, count(*) as n from doc_labels group by 1), p as (select *, hits / n::double as p from g)
    select annotator, hits, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as low,
           round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as high, round(3.0 / n, 6) as bound from p
    """,
)
def wilson_ci(spark, sf_dir):
    g = table(spark, sf_dir, "doc_labels").groupBy("annotator").agg(F.count_if(F.col("kind") == "prose").alias("hits"), F.count("*").alias("n"))
    low, high = X.wilson(F.col("hits"), F.col("n"))
    return g.select("annotator", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(X.rule_of_three(F.col("n")), 6).alias("bound"))


@query("sweep_settings", "select item_id, t as temperature, r as repeat, 'T' || t || '_r' || r as run from eval_items, (values (0.0::double), (0.3), (0.7), (1.0)) as a(t), (values (1), (2), (3), (4), (5)) as b(r)")
def sweep_settings(spark, sf_dir):
    return providers.sweep(table(spark, sf_dir, "eval_items").select("item_id"), [0.0, 0.3, 0.7, 1.0], 5).select("item_id", "temperature", "repeat", "run")


@query("replay_outputs", "select i.item_id, coalesce(d.lang, '[[CALL_FAILED]] no stored output') as raw from eval_items i left join documents d on d.doc_id = i.item_id")
def replay_outputs(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("raw"))
    return providers.replay(stored, table(spark, sf_dir, "eval_items"), ["item_id"]).select("item_id", "raw")


@query("provider_run", "select item_id, upper(left(text, 5)) as raw, true as ok, length(text) as tokens_in, 5 as tokens_out, true as timed from eval_items")
def provider_run(spark, sf_dir):
    """An offline provider called from the executors: its text, tokens and time."""
    ready = providers.prompts(table(spark, sf_dir, "eval_items"), "{job_description}", "text")
    out = providers.collect_outputs(ready, ["item_id"], lambda prompt, settings: (prompt[:5].upper(), len(prompt), 5))
    return out.select("item_id", "raw", F.col("error").isNull().alias("ok"), "tokens_in", "tokens_out", (F.col("seconds") >= 0).alias("timed"))


@query("event_windows", "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf_dir):
    w = windows.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "6 hours")
    return w.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "event_sessions",
    """
    with g as (select user_id, ts, (lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval '12 hours')::int as first from events),
    s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s
    """,
)
def event_sessions(spark, sf_dir):
    return windows.session_counts(table(spark, sf_dir, "events"), "ts", "user_id", "12 hours").select("user_id", "session_start", "n")
