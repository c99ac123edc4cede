"""Queries of the general field operators, packed values (p3) and quantities (p7), and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidex.operators.segment import unpack_all
from evidex.operators.units import normalize_pay
from evidex.plans.registry import Registry, table
from evidex.session import ensure_checkpoint_dir
from evidex.sources import files

registry = Registry()


@registry.query("p3_found")
def p3_found(spark, sf_dir):
    jobs = table(spark, sf_dir, "company_jobs_merged")
    info = table(spark, sf_dir, "jobinfo")
    return unpack_all(
        [
            (jobs, {"company_jobs_merged.skills": "skills"}, "row_id"),
            (info, {f"jobinfo.{c}": c for c in ("硬技能", "软技能", "AI相关技术栈要求")}, "info_id"),
        ]
    )


@registry.query("p3_value_counts")
def p3_value_counts(spark, sf_dir):
    return p3_found(spark, sf_dir).groupBy("field", "item").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


@registry.query("p7_found")
def p7_found(spark, sf_dir):
    jobs = normalize_pay(table(spark, sf_dir, "company_jobs_merged"), "row_id", "salary", field="company_jobs_merged.salary")
    info = normalize_pay(table(spark, sf_dir, "jobinfo"), "info_id", "最低薪资", "薪资周期", "jobinfo.最低薪资", ("low",))
    return jobs.unionByName(info)


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


_CSV_COLUMNS = ("ts_code", "title", "salary", "skills", "jd", "job_link")


@registry.query("csv_round_trip", f"select row_id::varchar as row_id, {', '.join(f"nullif({c}, '') as {c}" for c in _CSV_COLUMNS)} from company_jobs_merged")
def csv_round_trip(spark, sf_dir):
    """Postings written as CSV with a byte-order mark and read back: cells of several lines, quotes and blanks stay, an empty cell is null."""
    path = scratch(spark)
    files.write_csv(table(spark, sf_dir, "company_jobs_merged").select("row_id", *_CSV_COLUMNS), path, bom=True)
    return files.read_csv(spark, files.require(spark, path))


@registry.query("parquet_round_trip", "select doc_id, text, coalesce(lang, 'none') as lang from documents")
def parquet_round_trip(spark, sf_dir):
    """Documents written by language and read back."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"))
    files.write_parquet(docs, path, ["lang"])
    return files.optional(spark, path, spark.read.parquet)


@registry.query("json_round_trip", "select info_id, 硬技能 as skills from jobinfo")
def json_round_trip(spark, sf_dir):
    path = scratch(spark)
    files.write_json(table(spark, sf_dir, "jobinfo").select("info_id", F.col("硬技能").alias("skills")), path)
    return spark.read.schema("info_id bigint, skills string").json(path)


@registry.query(
    "missing_keys",
    """select distinct row_id, 'missing' as side from company_jobs_merged where row_id not in (select row_id from jobinfo where row_id is not null)
    union all select distinct row_id, 'unexpected' from jobinfo where row_id is not null and row_id not in (select row_id from company_jobs_merged)""",
)
def missing_keys(spark, sf_dir):
    """Postings without a record, and records of unknown postings."""
    info = table(spark, sf_dir, "jobinfo").where("row_id is not null")
    return files.missing_keys(table(spark, sf_dir, "company_jobs_merged"), info, "row_id")


@registry.query("only_listed", "select doc_id, lang from documents where lang in ('zh', 'mixed')")
def only_listed(spark, sf_dir):
    """Documents of the languages that a list names."""
    return files.only(table(spark, sf_dir, "documents"), "lang", "zh, mixed").select("doc_id", "lang")
