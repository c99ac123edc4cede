"""Keyword evidence, ordinal levels, class matrices and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.dictionaries import CALIBRATION, DEGREE_DEFAULT, DEGREE_LEVELS, EXPERIENCE_DEFAULT, EXPERIENCE_LEVELS
from evidex.functions.text import half_even, keyword_hits, level, pay_median_k


def keyword_features(df: DataFrame, text: Column, dictionaries: Mapping[str, Sequence[str]]) -> DataFrame:
    """hits, n and has of each dictionary, in one projection; each text is searched once a dictionary."""
    low = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    with_hits = low.select(*df.columns, *[keyword_hits(F.col("_low"), words, lowered=True).alias(f"{d}_hits") for d, words in dictionaries.items()])
    extra = []
    for d in dictionaries:
        extra += [F.size(f"{d}_hits").alias(f"n_{d}"), (F.size(f"{d}_hits") > 0).cast("int").alias(f"has_{d}")]
    return with_hits.select("*", *extra)


def barrier_flags(degree: Column, experience: Column) -> tuple[Column, Column]:
    """(low, senior): little asked for; much asked for."""
    return ((degree <= 2) | (experience <= 1)).cast("int"), ((experience >= 4) | (degree >= 4)).cast("int")


def job_features(df: DataFrame, dictionaries: Mapping[str, Sequence[str]]) -> DataFrame:
    """Postings with keyword evidence, levels, barrier flags and pay in thousands a month."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "skills", "jd")])
    out = keyword_features(df, text, dictionaries)
    out = out.withColumns({"degree_level": level(F.col("degree"), DEGREE_LEVELS, DEGREE_DEFAULT), "exp_level": level(F.col("experience"), EXPERIENCE_LEVELS, EXPERIENCE_DEFAULT), "salary_k": pay_median_k(F.col("salary"))})
    low, senior = barrier_flags(F.col("degree_level"), F.col("exp_level"))
    return out.withColumns({"low_barrier": low, "senior_barrier": senior})


#: Equal parts of a group's range of values in which its median is looked for.
PARTS = 4096


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): interpolated median of each group's values; groups without values have no row.

    Values are counted before the shuffle. The counts of PARTS parts of a group's range tell in which part
    its median lies, and only the values there are put in order, so that a hot group is neither held nor
    sorted in one task. Null and NaN are no values; null keys are left out.
    """
    by = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    spans = counts.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_all"))
    width = F.col("_high") - F.col("_low")
    place = F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(width, F.lit(0.0)) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    placed = counts.join(spans.select(*by, "_low", "_high"), by).select(*by, "_v", "_n", place.cast("int").alias("_part"))
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    parts = sums.withColumn("_to", upto).join(spans.select(*by, "_all"), by).where((F.col("_to") >= low) & (F.col("_to") - F.col("_n") < high))
    near = placed.join(parts.select(*by, "_part", "_all", (F.col("_to") - F.col("_n")).alias("_before")), [*by, "_part"])
    within = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = near.withColumn("_to", within + F.col("_before"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_n") < rank), F.col("_v")))

    return ranked.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(name))


def group_profile(df: DataFrame, keys: Sequence[str], company: str, pay: str, means: Mapping[str, str]) -> DataFrame:
    """Count, number of companies, exact median pay and means of each group; null keys are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(company).alias("companies"), *[F.avg(c).alias(name) for name, c in means.items()])
    return counted.join(exact_median(rows, keys, pay, "pay_median"), list(keys), "left")


def unit_scale(value: Column, part: Window | None = None, eps: float = 1e-9) -> Column:
    """(v - min) / (max - min + eps) over the whole frame or a part of it."""
    w = part or Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return (value - lo) / (hi - lo + F.lit(eps))


def calibrate(value: Column, part: Window | None = None, low: float = CALIBRATION[0], high: float = CALIBRATION[1]) -> Column:
    """Linear map of the frame's range onto [low, high]; the middle where all values are equal."""
    w = part or Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-9, F.lit((low + high) / 2)).otherwise(F.lit(low) + (value - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(high - low))


def category_matrix(jobs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row a class: profile, five raw dimension scores and their calibrated form; classes in `order` first.

    Windows run over the aggregated classes only, never over the jobs.
    """
    means = {"degree_mean": "degree_level", "exp_mean": "exp_level", "low_share": "low_barrier", "senior_share": "senior_barrier"}
    for d in ("ai", "digital", "human", "repeat", "creative", "rule"):
        means |= {f"{d}_cover": f"has_{d}", f"{d}_depth": f"n_{d}"}
    m = group_profile(jobs, ["category"], "official_name", "salary_k", means)
    c, z = F.col, lambda name: unit_scale(F.col(name))
    raw = {
        "R": 0.40 * c("repeat_cover") + 0.20 * z("repeat_depth") + 0.20 * (1 - c("creative_cover")) + 0.20 * c("low_share"),
        "S": 0.70 * c("rule_cover") + 0.30 * z("rule_depth"),
        "D": 0.70 * c("digital_cover") + 0.30 * z("digital_depth"),
        "A": 0.70 * c("ai_cover") + 0.30 * z("ai_depth"),
        "H": 0.55 * c("human_cover") + 0.20 * z("human_depth") + 0.25 * c("senior_share"),
    }
    m = m.withColumns({f"{d}_raw": x for d, x in raw.items()})
    m = m.withColumns({f"{d}_data": half_even(calibrate(F.col(f"{d}_raw")), 2) for d in raw})
    if order:
        place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
        m = m.withColumn("ord", place).where(F.col("ord") > 0).orderBy("ord")
    return m


def keyword_topk(df: DataFrame, hits: Mapping[str, str], k: int = 30) -> DataFrame:
    """(dimension, keyword, n, share, place): the k commonest keywords of each dimension, ties by keyword; share in percent of all rows."""
    packed = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(column).alias("words")) for name, column in hits.items()], F.struct(F.lit(None).cast("string").alias("dimension"), F.array(F.lit("")).alias("words")))
    rows = df.select(F.explode(packed).alias("x")).select("x.dimension", F.explode("x.words").alias("keyword"))
    # One row without a dimension for each row of df counts them all in the same pass.
    counts = rows.groupBy("dimension", "keyword").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("dimension").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    shares = counts.withColumn("share", F.col("n") * 100 / total).where(F.col("dimension").isNotNull() & (F.col("keyword") != ""))
    top = shares.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "keyword"))).where(F.col("place") <= k)
    return top.select("dimension", "keyword", "n", "share", "place")


def share_of_total(value: Column) -> Column:
    """Percent of the sum over the (aggregated) frame."""
    return value * 100 / F.nullif(F.sum(value).over(Window.partitionBy(F.lit(0))), F.lit(0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of the non-null values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", share_of_total(F.col("n")))
