"""Frames that charts are drawn from; drawing is left to the reader's tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.dictionaries import DIMENSIONS
from evidex.operators.scoring import bubble, quadrant


def role_ranking(roles: DataFrame, role: str = "role") -> DataFrame:
    """Bars by risk; weak ones are marked for hatching."""
    return roles.select("place", role, "Risk", "tier", (F.col("strength") == "weak").alias("hatched")).orderBy("place")


def risk_matrix(scored: DataFrame, label: str) -> DataFrame:
    """Points of risk against human need with bubble size and quadrant."""
    return scored.select(label, F.col("Risk").alias("x"), F.col("H").alias("y"), bubble(F.col("n")).alias("size"), quadrant(F.col("Risk"), F.col("H")).alias("quadrant"))


def radar(scored: DataFrame, label: str, picked: Sequence[str]) -> DataFrame:
    """Long (label, dimension, value) of the picked labels that are there, in the picked order."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    place = F.array_position(F.array(*map(F.lit, picked)), F.col(label))
    return scored.withColumn("ord", place).where("ord > 0").select("ord", label, F.explode(rows).alias("x")).select("ord", label, "x.*")


def heatmap(scored: DataFrame, label: str) -> DataFrame:
    return scored.select(label, *DIMENSIONS, "Risk").orderBy(F.desc("Risk"), label)


def coverage(matrix: DataFrame) -> DataFrame:
    """Coverage in percent of each keyword dimension."""
    return matrix.select("category", *[(F.col(f"{d}_cover") * 100).alias(d) for d in ("ai", "digital", "human", "repeat", "creative", "rule")])


def risk_pay(scored: DataFrame, label: str, mid_pay: float) -> DataFrame:
    """Points of risk against pay; rows without pay are left out."""
    rows = scored.where(F.col("pay_median").isNotNull())
    return rows.select(label, F.col("Risk").alias("x"), F.col("pay_median").alias("y"), bubble(F.col("n"), 22.0).alias("size"), quadrant(F.col("Risk"), F.col("pay_median"), 50.0, mid_pay).alias("quadrant"))
