"""The two pipelines as lazy plans: postings to scores, and model outputs to metrics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.dictionaries import Study
from evidex.functions.text import SLOT, half_even, lookup, normalize_title
from evidex.operators import classify as cls
from evidex.operators import dedupe, extraction, features, records, scoring
from evidex.session import cut


def prepare(postings: DataFrame, study: Study, order: str = "row_id") -> DataFrame:
    """Clean postings with city, std_title and text_all."""
    clean = dedupe.clean_postings(postings, order)
    text = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "skills", "jd")]))
    return clean.withColumns({"std_title": normalize_title(F.col("title"), study.titles), "text_all": text})


def classified(postings: DataFrame, study: Study, order: str = "row_id") -> DataFrame:
    return cls.classify(prepare(postings, study, order), study.rules, study.fallback, order)


def title_map(jobs: DataFrame) -> DataFrame:
    """(title, std_title, category, n): how free titles were read, commonest first."""
    rows = jobs.where(F.col("title").isNotNull() & F.col("std_title").isNotNull() & F.col("category").isNotNull())
    return rows.groupBy("title", "std_title", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title", "std_title", "category")


def category_summary(jobs: DataFrame) -> DataFrame:
    out = jobs.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("official_name").alias("companies"), F.countDistinct("std_title").alias("titles"))
    return out.withColumn("share", half_even(features.share_of_total(F.col("n")), 2)).orderBy(F.desc("n"), "category")


def scored(postings: DataFrame, study: Study, order: str = "row_id") -> dict[str, DataFrame]:
    """All result frames of the scoring pipeline. The jobs' features are worked out once, the rest is lazy."""
    wide = features.job_features(classified(postings, study, order), study.keywords)
    flags = [c for d in study.keywords for c in (f"n_{d}", f"has_{d}", f"{d}_hits")]
    jobs = cut(wide.select(order, "official_name", "title", "std_title", "category", "assign_method", "city", "salary_k", "degree_level", "exp_level", "low_barrier", "senior_barrier", *flags))
    matrix = features.category_matrix(jobs, study.order)
    scores = scoring.score_categories(matrix, study.priors, core=study.core, rationales=study.rationales)
    anchors = {r.name: r.anchor for r in study.roles}
    # Means of the anchors come from all jobs, so the claim rides along as a column.
    with_role = jobs.withColumn("role", cls.claim_role(F.col("title"), study.roles))
    roles, dropped = scoring.score_roles(with_role, scores, anchors)
    return {
        "jobs": jobs, "title_map": title_map(jobs), "summary": category_summary(jobs), "matrix": matrix, "scores": scores,
        "detail": scoring.dimension_detail(scores), "subgroups": scoring.score_subgroups(jobs, scores, core=study.core),
        "roles": roles, "roles_dropped": dropped, "sensitivity": scoring.sensitivity(scores, order=study.order),
        "keywords": features.keyword_topk(jobs, {d: f"{d}_hits" for d in study.keywords}),
    }


def run_log(postings: DataFrame, frames: dict[str, DataFrame], order: str = "row_id") -> DataFrame:
    """(stage, metric, value): the counts and rates of one run of scored.

    Rows after each step of cleaning, titles before and after, rows by way of classification, coverage
    of three dimensions and of pay in percent, range of Risk, classes by tier, roles and subgroups.
    """
    jobs, scores, roles = frames["jobs"], frames["scores"], frames["roles"]

    def long(df: DataFrame, stage: str, metrics: dict[str, Column]) -> DataFrame:
        row = df.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(m) for m, c in metrics.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select("x.*")

    def by_value(df: DataFrame, stage: str, column: str) -> DataFrame:
        return df.groupBy(column).agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), F.col(column).alias("metric"), F.col("n").cast("double").alias("value"))

    def percent(flag: Column) -> Column:
        return F.round(F.avg(flag.cast("int")) * 100, 2)

    rows = F.count("*")
    parts = [
        long(postings, "clean", {"raw": rows, "by link": F.countDistinct(F.coalesce("job_link", F.lit("\u0000")))}),
        long(jobs, "clean", {"clean": rows, "companies": F.countDistinct("official_name"), "titles": F.countDistinct("title"), "standard titles": F.countDistinct("std_title")}),
        by_value(jobs, "classify", "assign_method"),
        long(jobs, "features", {"ai": percent(F.col("has_ai") > 0), "digital": percent(F.col("has_digital") > 0), "human": percent(F.col("has_human") > 0), "pay": percent(F.col("salary_k").isNotNull())}),
        long(scores, "scores", {"highest": F.max("Risk"), "lowest": F.min("Risk"), "classes": rows}),
        by_value(scores, "tiers", "tier"),
        long(roles, "roles", {"ranked": rows, "coverage": F.round(F.sum("share") / 100, 3)}),
        long(frames["roles_dropped"], "roles", {"dropped": rows}),
        long(frames["subgroups"], "subgroups", {"scored": rows}),
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluated(outputs: DataFrame, gold: DataFrame, samples: DataFrame, study: Study, by: tuple[str, ...] = ("version",), key: str = "sample_id", accepts: DataFrame | None = None, support: DataFrame | None = None, templates: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """All metric frames of the evaluation pipeline from raw outputs (by, key, raw), gold records and source texts.

    The outputs are parsed once, the metrics are lazy. templates has the prompt of each value of by[0]
    for the costs; without one the source text is the prompt. Several outputs of one (by, key) are
    runs of it, which consistency and drift compare.
    """
    parsed = cut(records.parse_outputs(outputs, [*by, key], "raw"))
    signed = extraction.record_signatures(parsed, [*by, key], study.aliases)
    template = lookup(F.col(by[0]), templates or {}, F.lit(SLOT))
    calls = outputs.join(samples.select(key, "input_text"), key).withColumn("prompt", F.replace(template, F.lit(SLOT), F.coalesce("input_text", F.lit(""))))
    results = extraction.field_results(parsed, gold, [key], by, accepts, study.aliases)
    unit_rows = extraction.units(parsed, [*by, key])
    judged = extraction.verdicts(unit_rows, samples, [key], "input_text", support, study.aliases)
    return {
        "parsed": parsed, "levels": extraction.level_counts(parsed, by), "results": results, "accuracy": extraction.accuracy(results, by),
        "by_field": extraction.accuracy(results, [*by, "field"]), "lists": extraction.list_metrics(results, [*by, "field"]),
        "judged": judged, "hallucination": extraction.hallucination(judged, by, key), "queue": extraction.screening_queue(judged, key, by[0]),
        "consistency": extraction.consistency(signed, by, [key, "field"]), "by_field_consistency": extraction.consistency(signed, [*by, "field"], [key]),
        "drift": extraction.drift(signed, by, [key, "field"]), "costs": extraction.costs(calls, by, F.col("prompt"), F.coalesce("raw", F.lit(""))),
    }
