import json
import time

import pytest
from pyspark.sql import functions as F

from evidex.sources import files, providers
from evidex.streaming import windows


def test_csv(spark, tmp_path, rows):
    path = tmp_path / "a.csv"
    path.write_bytes('title,jd\n会计,"多行\n""引号"""\n,\n'.encode("gb18030"))
    df = files.read_csv(spark, str(path), files.T.StructType([files.T.StructField("title", files.T.StringType()), files.T.StructField("jd", files.T.StringType())]), "GB18030", "row_id")
    assert rows(df.select("title", "jd")) == [(None, None), ("会计", '多行\n"引号"')]
    files.write_csv(df.select("title"), str(tmp_path / "out"), bom=True)
    assert files.read_csv(spark, str(tmp_path / "out")).columns == ["title"]
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_json_and_paths(spark, tmp_path, rows):
    (tmp_path / "k.json").write_text('{"a": ["x"], "_doc": null, "b": []}', encoding="utf-8")
    assert rows(files.read_keyed_json(spark, str(tmp_path / "k.json"), "array<string>")) == [("a", ["x"]), ("b", [])]
    (tmp_path / "t.txt").write_text("提取 {job_description}", encoding="utf-8")
    assert files.read_template(spark, str(tmp_path / "t.txt")) == "提取 {job_description}"
    with pytest.raises(FileNotFoundError):
        files.require(spark, str(tmp_path / "none"), "put it there")
    assert files.optional(spark, str(tmp_path / "none"), spark.read.text) is None
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(files.missing_keys(df, df.where("k = 'a'"), "k")) == [("b", "missing")]
    assert files.only(df, "k", "b, c").count() == 1 and files.only(df, "k", "").count() == 2
    assert not files.write_if_any(df.limit(0), str(tmp_path / "w")) and files.write_if_any(df, str(tmp_path / "w"))


def test_providers(spark):
    def call(prompt, settings):
        if "bad" in prompt:
            raise RuntimeError("no")
        return f"{prompt}@{settings.temperature}", settings.max_tokens, 2

    samples = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "sid string, input_text string")
    swept = providers.sweep(samples, [0.0, 0.5], 2)
    assert swept.count() == 12
    out = providers.collect_outputs(providers.prompts(swept, "<{job_description}>"), ["sid", "run"], call)
    got = {(r.sid, r.run): (r.raw, r.error) for r in out.collect()}
    assert got["a", "T0.5_r2"] == ("<x>@0.5", None)
    assert got["b", "T0.0_r1"] == ("[[CALL_FAILED]] no", "no")
    assert got["c", "T0.0_r1"][0] == "<>@0.0"
    times = {r.run: (r.calls, r.failed, r.tokens_in) for r in providers.call_times(out, ["run"]).collect()}
    assert times["T0.5_r1"] == (3, 1, 1500.0)
    # Three calls of one task, one after another.
    slow = providers.collect_outputs(providers.prompts(samples, "{job_description}").coalesce(1), ["sid"], call, providers.Settings(temperature=0.3, max_tokens=7), pause=0.3)
    began = time.time()
    assert {(r.raw, r.tokens_in) for r in slow.collect()} == {("x@0.3", 7), ("[[CALL_FAILED]] no", 0), ("@0.3", 7)} and time.time() - began > 0.9


def test_order_of_several_files(spark, tmp_path):
    for name, values in (("b.csv", "3\n4\n"), ("a.csv", "1\n2\n"), ("c 文.csv", "5\n6\n" + "7\n" * 3)):
        (tmp_path / name).write_text("v\n" + values, encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path), row_id="row_id").repartition(3)
    got = [r.v for r in df.orderBy("row_id").collect()]
    assert got == ["1", "2", "3", "4", "5", "6", "7", "7", "7"] and df.select("row_id").distinct().count() == 9


def test_paths_from_the_environment(monkeypatch):
    monkeypatch.delenv("JOBS_RAW_CSV", raising=False)
    assert files.raw_path("here.csv") == "here.csv"
    monkeypatch.setenv("JOBS_RAW_CSV", "there.csv")
    assert files.raw_path("here.csv") == "there.csv"


def test_command_line(spark, tmp_path, capsys):
    from evidex.__main__ import main

    study = {"rules": [{"name": "a", "keywords": ["java"]}], "fallback": "b", "keywords": {d: ["x"] for d in ("ai", "digital", "human", "repeat", "creative", "rule")},
             "priors": {c: {d: 50.0 for d in "RSDAH"} for c in "ab"}, "roles": [{"name": "r", "pattern": "java", "anchor": "a"}]}
    (tmp_path / "study.json").write_text(json.dumps(study), encoding="utf-8")
    columns = [c for c in files.POSTING_COLUMNS]
    rows = [{**dict.fromkeys(columns), "title": f"java{i % 3}", "company_name": f"c{i}", "job_link": f"l{i}"} for i in range(12)]
    schema = "row_id bigint, " + ", ".join(f"{c} string" for c in columns)
    spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema).write.parquet(str(tmp_path / "postings"))
    main(["score", "--postings", str(tmp_path / "postings"), "--study", str(tmp_path / "study.json"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "log")).where("metric = 'clean'").first()["value"] == 12
    spark.createDataFrame([("s1", "文"), ("s2", "字")], "sample_id string, input_text string").write.parquet(str(tmp_path / "samples"))
    (tmp_path / "t.txt").write_text("<{job_description}>", encoding="utf-8")
    main(["collect", "--samples", str(tmp_path / "samples"), "--template", str(tmp_path / "t.txt"), "--version", "v1", "--provider", "evidex.sources.providers:echo", "--subset", "s1", "--out", str(tmp_path / "raw")])
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == ["<文>"]
    assert "v1" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(i, f"2024-01-01 0{i % 4}:10:00", i % 2) for i in range(20)], "v int, ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    stream = windows.read_stream(spark, src, df.schema)
    query = windows.windowed_counts(stream, "ts", ["k"], "v", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted(map(tuple, spark.table("counts").collect()))
    assert got == sorted(map(tuple, windows.windowed_counts(df, "ts", ["k"], "v", "1 hour").collect()))
    seen = windows.write_stream(windows.first_seen(stream, "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
