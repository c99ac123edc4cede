"""Blending of evidence with priors, weighted scores, tiers, ranks, robustness and clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.dictionaries import DIMENSIONS, EVIDENCE_WEIGHTS, TIERS, TIME_FACTORS, WEIGHTS
from evidex.functions.text import half_even
from evidex.operators.features import group_profile


def whole() -> Window:
    """One window over a whole aggregated frame."""
    return Window.partitionBy(F.lit(0))


def shrinkage(n: Column, base: float = 1.0, k: float = 30.0) -> Column:
    """Weight of the evidence of n rows."""
    return F.lit(base) * n / (n + F.lit(k))


def blend(n: Column, data: Column, prior: Column, base: float, k: float = 30.0) -> Column:
    w = shrinkage(n, base, k)
    return w * data + (1 - w) * prior


def clip(value: Column, low: float = 5.0, high: float = 95.0) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def weighted_score(dims: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS, inverted: Sequence[str] = ("H",)) -> Column:
    """Weighted sum of dimension scores; inverted ones count as 100 less the score."""
    out = None
    for d, w in weights.items():
        part = F.lit(w) * ((100 - dims[d]) if d in inverted else dims[d])
        out = part if out is None else out + part
    return out


def tier(score: Column, tiers: Sequence[tuple[float, str]] = TIERS) -> Column:
    """Name of the first tier whose lower bound the score reaches; below all bounds the last one."""
    out = None
    for low, name in tiers[:-1]:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return F.when(score.isNotNull(), out.otherwise(tiers[-1][1]))


def strength(n: Column, names: tuple[str, str, str] = ("strong", "middle", "weak")) -> Column:
    return F.when(n >= 50, names[0]).when(n >= 20, names[1]).otherwise(names[2])


def average_rank(value: Column, by: Sequence[Column] = (), descending: bool = True) -> Column:
    """Rank within `by` where ties share the mean of their places. Without `by` for aggregated frames: it is one sort."""
    by = list(by) or [F.lit(0)]
    w = Window.partitionBy(*by)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns, null where one of them doesn't vary: the built-in one divides by zero there."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row rho: correlation of average ranks, null where a column doesn't vary.

    For frames of classes: each of the two ranks is one sort in one task.
    """
    ranked = df.select(average_rank(F.col(a)).alias("ra"), average_rank(F.col(b)).alias("rb"))
    return ranked.agg(correlation("ra", "rb").alias("rho"))


def score_categories(matrix: DataFrame, priors: Mapping[str, Mapping[str, float]], k: float = 30.0, core: Sequence[str] = (), rationales: Mapping[str, str] | None = None) -> DataFrame:
    """Matrix rows with prior, evidence weight and blended score of each dimension, Risk, tier, rank, is_core and rationale.

    Classes without a prior are left out. Risk is computed from rounded dimensions; rationale is the
    stated reason of a class's prior, null without any.
    """
    spark = matrix.sparkSession
    prior_rows = [(c, *[float(p[d]) for d in DIMENSIONS], c in core, (rationales or {}).get(c)) for c, p in priors.items()]
    prior = spark.createDataFrame(prior_rows, "category string, " + ", ".join(f"{d}_expert double" for d in DIMENSIONS) + ", is_core boolean, rationale string")
    m = matrix.join(F.broadcast(prior), "category")
    m = m.withColumns({f"{d}_weight": shrinkage(F.col("n"), EVIDENCE_WEIGHTS[d], k) for d in DIMENSIONS})
    m = m.withColumns({d: half_even(F.col(f"{d}_weight") * F.col(f"{d}_data") + (1 - F.col(f"{d}_weight")) * F.col(f"{d}_expert"), 2) for d in DIMENSIONS})
    m = m.withColumn("Risk", half_even(weighted_score({d: F.col(d) for d in DIMENSIONS}), 1))
    return m.withColumns({"tier": tier(F.col("Risk")), "place": F.floor(average_rank(F.col("Risk"))).cast("int")})


def dimension_detail(scored: DataFrame) -> DataFrame:
    """(category, dimension, data, prior, weight, blended): the long form of score_categories."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_data").alias("data"), F.col(f"{d}_expert").alias("prior"), half_even(F.col(f"{d}_weight"), 3).alias("weight"), F.col(d).alias("blended")) for d in DIMENSIONS])
    return scored.select("category", F.explode(rows).alias("x")).select("category", "x.*")


_EVIDENCE = {"R": "has_repeat", "S": "has_rule", "D": "has_digital", "A": "has_ai", "H": "has_human"}


def _offset(frame: DataFrame, adjust: float, shrunk: Column, barrier: Column) -> DataFrame:
    dims = {d: clip(F.col(f"base_{d}") + (F.col(f"own_{d}") - F.col(f"mean_{d}")) * F.lit(adjust) * shrunk) for d in DIMENSIONS}
    frame = frame.withColumns({d: half_even(x, 2) for d, x in dims.items()})
    frame = frame.withColumn("R", half_even(clip(F.col("R") + (F.col("own_low") - F.col("mean_low")) * 12 * barrier), 2))
    frame = frame.withColumn("Risk", half_even(weighted_score({d: F.col(d) for d in DIMENSIONS}), 1))
    return frame.withColumn("tier", tier(F.col("Risk")))


def _bases(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Blended score and job-weighted mean evidence of each class."""
    means = jobs.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("anchor")).agg(*[F.avg(c).alias(f"mean_{d}") for d, c in _EVIDENCE.items()], F.avg("low_barrier").alias("mean_low"))
    base = scores.select(F.col("category").alias("anchor"), *[F.col(d).alias(f"base_{d}") for d in DIMENSIONS])
    return means.join(base, "anchor")


def score_subgroups(jobs: DataFrame, scores: DataFrame, group: str = "std_title", least: int = 5, adjust: float = 35.0, core: Sequence[str] = ()) -> DataFrame:
    """Scores of (category, group) with at least `least` jobs: the class's score moved by the group's own evidence.

    Groups below the bound still count in the class means.
    """
    own = {f"own_{d}": c for d, c in _EVIDENCE.items()} | {"own_low": "low_barrier"}
    groups = group_profile(jobs, ["category", group], "official_name", "salary_k", own).where(F.col("n") >= least)
    joined = groups.join(_bases(jobs, scores), groups["category"] == F.col("anchor"), "left").drop("anchor")
    out = _offset(joined, adjust, shrinkage(F.col("n"), 1.0, 15.0), F.lit(1.0))
    return out.withColumn("is_core", F.col("category").isin(*core) if core else F.lit(False))


def score_roles(jobs: DataFrame, scores: DataFrame, anchors: Mapping[str, str], role: str = "role", least: int = 5, adjust: float = 35.0) -> tuple[DataFrame, DataFrame]:
    """(ranked, dropped): scores of claimed roles from their anchor class; roles with too few jobs are dropped.

    A dropped role keeps its rows, as its claim comes first. Ranked roles have their share of all jobs
    in percent and the coverage of each dimension's evidence (own_R to own_H).
    """
    own = {f"own_{d}": c for d, c in _EVIDENCE.items()} | {"own_low": "low_barrier"}
    # The share of all jobs, those that no role claims included.
    counts = jobs.groupBy(role).agg(F.count("*").alias("_n"))
    shares = counts.withColumn("share", half_even(F.col("_n") * 100 / F.sum("_n").over(whole()), 2)).where(F.col(role).isNotNull()).select(role, "share")
    groups = group_profile(jobs, [role], "official_name", "salary_k", own).join(shares, role)
    spark = jobs.sparkSession
    names = spark.createDataFrame([(r, a, i) for i, (r, a) in enumerate(anchors.items())], f"{role} string, anchor string, ord int")
    full = names.join(groups, role, "left").na.fill(0, ["n", "companies"])
    dropped = full.where(F.col("n") < least).select(role, "n", "ord")
    joined = full.where(F.col("n") >= least).join(_bases(jobs, scores), "anchor")
    w = shrinkage(F.col("n"), 1.0, 15.0)
    out = _offset(joined, adjust, w, w).withColumns({"weight": half_even(w, 3), "strength": strength(F.col("n"))})
    return out.withColumn("place", F.row_number().over(whole().orderBy(F.desc("Risk"), "ord"))), dropped


def scenario_weights(weights: Mapping[str, float] = WEIGHTS, step: float = 0.05) -> dict[str, dict[str, float]]:
    """Weight sets of a sensitivity check: equal ones, and each weight raised at the cost of the others."""
    out = {"equal": dict.fromkeys(weights, 1.0 / len(weights))}
    for d in weights:
        out[f"{d}+{step:g}"] = {x: w + (step if x == d else -step / (len(weights) - 1)) for x, w in weights.items()}
    return out


def sensitivity(scored: DataFrame, label: str = "category", risk: str = "Risk", weights: Mapping[str, float] = WEIGHTS, order: Sequence[str] = ()) -> DataFrame:
    """(scenario, rho, highest, lowest, spread): other weights, priors only and data only against the baseline ranks.

    Scenarios are columns turned into rows of the small scored frame. Of labels with equal scores the
    one that is earlier in order stands, or by name without an order.
    """
    plain = {d: F.col(d) for d in weights}
    cases = {name: weighted_score(plain, w) for name, w in scenario_weights(weights).items()}
    for suffix, name in (("expert", "prior only"), ("data", "data only")):
        if all(f"{d}_{suffix}" in scored.columns for d in weights):
            cases[name] = weighted_score({d: F.col(f"{d}_{suffix}") for d in weights}, weights)
    # Rounding keeps scores that are equal but for the last bits of a double tied.
    rows = F.array(*[F.struct(F.lit(name).alias("scenario"), F.round(x, 9).alias("score")) for name, x in cases.items()])
    long = scored.select(F.col(label).alias("label"), F.col(risk).alias("base"), F.explode(rows).alias("x")).select("label", "base", "x.*")
    by = Window.partitionBy("scenario")

    def ranks(c: str) -> Column:
        return F.rank().over(by.orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy("scenario", c)) - 1) / 2

    ranked = long.withColumns({"rb": ranks("base"), "rs": ranks("score")})
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label")) if order else F.lit(0)
    return ranked.groupBy("scenario").agg(
        correlation("rb", "rs").alias("rho"), F.min_by("label", F.struct(-F.col("score"), place, "label")).alias("highest"),
        F.min_by("label", F.struct("score", place, "label")).alias("lowest"), (F.max("score") - F.min("score")).alias("spread"),
    )


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, starts: int = 20, seed: int = 42) -> DataFrame:
    """df with cluster: the fit of least cost of several starts. The rows are cached once for all starts."""
    from pyspark import StorageLevel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = None
        for s in range(seed, seed + starts):
            model = KMeans(k=k, seed=s, featuresCol="_v", predictionCol="cluster").fit(rows)
            if best is None or model.summary.trainingCost < best.summary.trainingCost - 1e-12:
                best = model
    finally:
        rows.unpersist()
    assembled = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)
    return best.transform(assembled).drop("_v")


def name_clusters(df: DataFrame, score: str, names: Sequence[str]) -> DataFrame:
    """df with cluster_name: clusters named in the order of their mean score, highest first."""
    means = df.groupBy("cluster").agg(F.avg(score).alias("m"))
    named = means.withColumn("place", F.row_number().over(whole().orderBy(F.desc("m"), "cluster")))
    return df.join(F.broadcast(named.select("cluster", F.element_at(F.array(*map(F.lit, names)), F.col("place")).alias("cluster_name"))), "cluster")


def agreement(a: Column, b: Column) -> Column:
    """Share of rows where two labels agree."""
    return F.avg(a.eqNullSafe(b).cast("int"))


def time_structure(tasks: DataFrame, owner: str = "owner", share: str = "share", factors: Mapping[str, float] = TIME_FACTORS) -> DataFrame:
    """(owner, before, after): working time by who does a task, and after the factors, in percent."""
    grouped = tasks.groupBy(F.col(owner).alias("owner")).agg(F.sum(share).alias("before"))
    left = F.col("before") * F.coalesce(*[F.when(F.col("owner") == o, F.lit(f)) for o, f in factors.items()], F.lit(1.0))
    return grouped.withColumn("after", left / F.sum(left).over(whole()) * 100)


def quadrant(x: Column, y: Column, mid_x: float = 50.0, mid_y: float = 50.0, names: tuple[str, str, str, str] = ("I", "II", "III", "IV")) -> Column:
    """Quadrant of a point: I high x and y, II low x, III both low, IV low y."""
    return F.when((x >= mid_x) & (y >= mid_y), names[0]).when((x < mid_x) & (y >= mid_y), names[1]).when((x < mid_x) & (y < mid_y), names[2]).otherwise(names[3])


def bubble(n: Column, k: float = 26.0) -> Column:
    return 90 + F.pow(n, F.lit(0.62)) * k


def with_clusters(scored: DataFrame, names: Sequence[str] = tuple(name for _, name in TIERS), k: int = 3) -> DataFrame:
    """scored with cluster and cluster_name: classes clustered by their dimensions, clusters named from the riskiest on."""
    return name_clusters(kmeans(scored, list(DIMENSIONS), k), "Risk", names)
