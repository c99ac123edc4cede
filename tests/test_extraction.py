import json

import pytest

from evidex.dictionaries import LIST_FIELDS, SCALAR_FIELDS
from evidex.operators import extraction as X
from evidex.operators import records

GOOD = {"职位名称": "分析师", "薪资范围": {"最低薪资": "10K", "最高薪资": "15K", "薪资周期": "月"}, "工作地点": "上海", "技能要求": {"硬技能": ["SQL", "sql", "Excel"], "软技能": []}, "学历要求": "本科", "经验要求": None, "AI相关技术栈要求": ["RAG"]}


@pytest.fixture
def parse(spark):
    """The record of one raw text."""

    def one(raw):
        rows = records.parse_outputs(spark.createDataFrame([(0, raw)], "k int, raw string"), ["k"], "raw").collect()
        return rows[0].asDict()

    return one


def test_ladder(parse):
    plain = json.dumps(GOOD, ensure_ascii=False)
    strict = parse(plain)
    assert strict["level"] == "strict" and strict["schema_ok"] and strict["硬技能"] == ["SQL", "Excel"]
    fenced = parse("```json\n" + plain[:-1] + ",}\n```")
    assert fenced["level"] == "repaired" and {k: fenced[k] for k in SCALAR_FIELDS} == {k: strict[k] for k in SCALAR_FIELDS}
    assert parse("说明：" + plain.replace('"', "“", 1).replace('"', "”", 1))["level"] == "repaired"
    loose = parse('{"薪资": "15000-30000元/月", "技能": {"硬技能": "Java、SQL"}, "学历": "无"}')
    assert (loose["最低薪资"], loose["最高薪资"], loose["薪资周期"], loose["硬技能"], loose["学历要求"], loose["schema_ok"]) == ("15000元", "30000元", "月", ["Java", "SQL"], None, False)
    assert parse("[1]")["errors"] == ["not an object"]
    null = parse("null")
    assert (null["level"], null["json_level"]) == ("text", "strict")
    text = parse("1. **职位名称**：会计\n| 工作地点 | 北京 |\n- 硬技能: SQL、Excel\n职位名称：第二个\n薪资：10-15K·13薪")
    assert (text["level"], text["职位名称"], text["工作地点"], text["硬技能"], text["最低薪资"], text["薪资周期"]) == ("text", "会计", "北京", ["SQL", "Excel"], "10K", "13薪")
    for raw in (None, "", "{", "```", "a" * 100_000):
        assert parse(raw)["level"] == "text"


def test_parsed_fields_versions(spark, rows, tmp_path):
    from evidex.plans.extraction_queries import parsed_fields

    columns = ["info_id", "row_id", "sample_id", "run", "version", *SCALAR_FIELDS, *LIST_FIELDS]
    values = {"职位名称": "会计。", "最低薪资": "10K", "最高薪资": "15K", "薪资周期": "月", "软技能": "沟通、协作、沟通"}
    info = [tuple({"info_id": k, "row_id": k, "sample_id": "s", "run": "r", "version": v}.get(c, values.get(c)) for c in columns) for k, v in enumerate(["v1", "v2", "v3"])]
    schema = ", ".join(f"`{c}` {'bigint' if c.endswith('w_id') or c == 'info_id' else 'string'}" for c in columns)
    spark.createDataFrame(info, schema).write.parquet(str(tmp_path / "jobinfo.parquet"))
    # Free text (v1) states neither pay nor soft skills.
    assert rows(parsed_fields(spark, str(tmp_path))) == [(0, "会计", None, None, ""), (1, "会计", "10K", "月", "沟通¦协作"), (2, "会计", "10K", "月", "沟通¦协作")]


def test_evaluation(spark, rows):
    raw = [("v1", "s1", json.dumps(GOOD)), ("v1", "s2", "职位名称：会计"), ("v2", "s1", json.dumps(GOOD | {"学历要求": "硕士"})), ("v2", "s2", "")]
    parsed = records.parse_outputs(spark.createDataFrame(raw, "version string, sid string, raw string"), ["version", "sid"], "raw")
    gold = records.parse_outputs(spark.createDataFrame([("s1", json.dumps(GOOD)), ("s2", "职位名称：财务会计")], "sid string, raw string"), ["sid"], "raw")
    accepts = spark.createDataFrame([("s2", "职位名称", ["会计"])], "sid string, field string, accepts array<string>")
    results = X.field_results(parsed, gold, ["sid"], ["version"], accepts)
    bad = rows(results.where("not ok").select("version", "sid", "field"))
    assert bad == [("v2", "s1", "学历要求"), ("v2", "s2", "职位名称")]
    n = len(SCALAR_FIELDS) + len(LIST_FIELDS)
    assert rows(X.accuracy(results, ["version"])) == [("v1", 1.0, 1.0, 2 * n), ("v2", (2 * n - 2) / (2 * n), (2 * n - 2) / (2 * n), 2 * n)]
    unit_rows = X.units(parsed, ["version", "sid"])
    sources = spark.createDataFrame([("s1", "招聘分析师，上海，10K-15K，sql，excel，rag，本科，15元/月"), ("s2", "会计")], "sid string, input_text string")
    support = spark.createDataFrame([("s1", "硕士", "HALLUCINATION", "made up")], "sid string, unit string, verdict string, reason string")
    judged = X.verdicts(unit_rows, sources, ["sid"], "input_text", support)
    assert rows(judged.where("not supported").select("version", "unit", "reason")) == [("v2", "硕士", "made up")]
    assert rows(X.screening_queue(judged, "sid", "version")) == [("s1", "硕士", ["v2/学历要求"])]
    rates = {r.version: (r.units, r.bad_units, r.sample_rate) for r in X.hallucination(judged, ["version"], "sid").collect()}
    assert rates == {"v1": (10, 0, 0.0), "v2": (9, 1, 1.0)}
    signatures = X.record_signatures(parsed, ["version", "sid"])
    same = X.consistency(signatures, [], ["sid", "field"]).first()
    assert (same.same, same.n) == (2 * n - 2, 2 * n)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, raw string")
    parsed = records.parse_outputs(none, ["k"], "raw")
    assert parsed.count() == 0 and X.units(parsed, ["k"]).count() == 0 and X.level_counts(parsed, ["k"]).count() == 0
