"""Published numbers of the study whose capabilities this engine has."""

import pytest
from pyspark.sql import functions as F

from evidex.dictionaries import DIMENSIONS
from evidex.operators import extraction, scoring

# Number of jobs, observed evidence and prior of R, S, D, A, H of each class, in the classes' fixed order,
# and the published risk.
CLASSES = [
    (72, (23.76, 38.85, 60.33, 90.0, 33.34), (38, 45, 95, 58, 70), 54.4),
    (154, (37.9, 33.71, 90.0, 49.54, 23.65), (58, 60, 95, 78, 45), 64.2),
    (8, (46.38, 50.8, 34.68, 10.0, 46.13), (78, 85, 82, 80, 38), 73.8),
    (20, (58.67, 90.0, 21.63, 14.7, 64.4), (55, 72, 85, 75, 55), 61.3),
    (28, (63.62, 55.92, 27.91, 19.97, 69.74), (52, 80, 70, 62, 62), 55.5),
    (55, (90.0, 36.7, 31.52, 10.0, 22.47), (88, 90, 85, 85, 25), 72.8),
    (37, (45.98, 76.94, 17.59, 10.0, 90.0), (62, 68, 80, 72, 48), 56.5),
    (63, (34.37, 23.7, 20.76, 13.96, 34.43), (42, 45, 78, 60, 70), 43.7),
    (732, (36.46, 10.0, 10.0, 10.17, 24.58), (40, 45, 55, 52, 82), 35.0),
    (599, (46.54, 16.62, 14.04, 12.86, 61.4), (45, 42, 45, 45, 85), 32.9),
    (230, (24.07, 38.29, 41.48, 25.29, 72.75), (35, 42, 70, 55, 75), 38.7),
    (966, (10.0, 19.4, 68.29, 23.4, 10.0), (55, 58, 92, 72, 45), 53.7),
    (290, (49.15, 24.73, 23.17, 16.82, 38.27), (50, 55, 45, 40, 60), 41.1),
]
NAMES = [f"c{k:02d}" for k in range(len(CLASSES))]
# Rank correlation, highest class, lowest class and spread of each scenario.
SCENARIOS = {
    "equal": (0.9615, "c02", "c09", 41.1), "prior only": (0.9725, "c05", "c09", 45.4), "data only": (0.7747, "c01", "c09", 29.4), "R+0.05": (1.0, "c02", "c09", 40.2),
    "S+0.05": (1.0, "c02", "c09", 41.5), "D+0.05": (0.9945, "c02", "c09", 41.4), "A+0.05": (0.9945, "c02", "c09", 41.1), "H+0.05": (0.9835, "c02", "c09", 40.4),
}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(name, n, *map(float, data)) for name, (n, data, _, _) in zip(NAMES, CLASSES)]
    matrix = spark.createDataFrame(rows, "category string, n bigint, " + ", ".join(f"{d}_data double" for d in DIMENSIONS))
    priors = {name: dict(zip(DIMENSIONS, map(float, prior))) for name, (_, _, prior, _) in zip(NAMES, CLASSES)}
    return scoring.score_categories(matrix, priors, core=("c02",), rationales={"c02": "why"}).cache()


def test_risk_tiers_ranks(scores):
    got = {r.category: r for r in scores.collect()}
    assert {k: r.Risk for k, r in got.items()} == {name: risk for name, (*_, risk) in zip(NAMES, CLASSES)}
    assert sorted(r.tier for r in got.values()) == sorted(["高替代风险"] * 2 + ["中等替代风险"] * 8 + ["低替代风险"] * 3)
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1].place)][:4] == ["c02", "c05", "c01", "c03"]
    assert (got["c02"].is_core, got["c02"].rationale, got["c03"].is_core, got["c03"].rationale) == (True, "why", False, None)


def test_scenarios(scores):
    got = {r.scenario: (round(r.rho, 4), r.highest, r.lowest, round(r.spread, 1)) for r in scoring.sensitivity(scores, order=NAMES).collect()}
    assert got == SCENARIOS


def test_ties_go_by_order(scores):
    level = scores.withColumns({d: F.lit(50.0) for d in DIMENSIONS})
    for order in (NAMES, NAMES[::-1]):
        assert {(r.highest, r.lowest) for r in scoring.sensitivity(level, order=order).where("scenario not like '%only'").collect()} == {(order[0], order[0])}


def test_clusters(scores):
    named = scoring.with_clusters(scores)
    assert round(named.agg(scoring.agreement(F.col("tier"), F.col("cluster_name"))).first()[0], 3) == 0.615
    assert {r.category for r in named.where("cluster_name = '高替代风险'").collect()} == {"c02", "c03", "c04", "c05", "c06"}


def test_hours(spark):
    tasks = spark.createDataFrame([("A", 56.0), ("C", 28.0), ("H", 16.0)], "owner string, share double")
    assert {r.owner: round(r.after) for r in scoring.time_structure(tasks).collect()} == {"A": 21, "C": 39, "H": 40}


def test_unit_rates(spark):
    """33 of 410, 5 of 427 and none of 405 units; both missing is right, one missing is wrong."""
    rows = [(v, s, k >= bad) for v, n, bad in (("v1", 410, 33), ("v2", 427, 5), ("v3", 405, 0)) for k in range(n) for s in [f"s{k % 20}"]]
    judged = spark.createDataFrame(rows, "version string, sid string, supported boolean")
    got = {r.version: (r.units, r.bad_units, round(100 * r.unit_rate, 2)) for r in extraction.hallucination(judged, ["version"], "sid").collect()}
    assert got == {"v1": (410, 33, 8.05), "v2": (427, 5, 1.17), "v3": (405, 0, 0.0)}
    pairs = spark.createDataFrame([(None, None), (None, "的"), ("x", None), ("x", "x")], "p string, g string")
    right = extraction.null_aware_equal(F.col("p"), F.col("g"), F.coalesce(F.col("p"), F.lit("")) == F.col("g"))
    assert [r[0] for r in pairs.select(right).collect()] == [True, False, False, True]
