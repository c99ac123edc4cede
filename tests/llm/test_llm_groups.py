import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from evidex.llm import copies, quantiles, terms
from evidex.llm.matching import map_fields, map_values, similar_entries, unmatched_values


def canonical(values):
    out = []
    for v in values:
        v = (v or "").lower()
        kept = "".join(c for i, c in enumerate(v) if c.isalnum() or (c == "." and 0 < i < len(v) - 1 and v[i - 1].isdigit() and v[i + 1].isdigit()))
        if kept:
            out.append(kept)
    return tuple(sorted(out))


def test_copies(spark, rows):
    random.seed(2)
    base = ["Acme Ltd", "数据工程师", "8.5-10K", "85-10K", "上海·浦东", None, "", "！"]
    data = []
    for i in range(600):
        # A third of all rows belong to one group, in changing notation and order.
        vals = [random.choice([" ACME, ltd", "acme-LTD"]), "数据 工程师", random.choice(["8.5-10k", "(8.5-10K)"]), "上海，浦东"] if i % 3 == 0 else [random.choice(base) for _ in range(4)]
        random.shuffle(vals)
        data.append((i, *vals, "k"))
    data += [(None, "Acme Ltd", "a", "b", "c", "k")]
    df = spark.createDataFrame(data, "id bigint, a string, b string, c string, d string, key string")
    groups = defaultdict(list)
    for i, *vals, _ in data:
        if i is not None:
            groups[canonical(vals)].append(i)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    for hot in (20, 10_000):
        assert rows(copies.copies(df, "id", ["a", "b", "c", "d"], hot)) == want
        assert rows(copies.collapsed(df, "id", ["a", "b", "c", "d"], hot)) == sorted((min(g), len(g)) for g in groups.values())
    assert copies.copies(df.limit(0), "id", ["a", "b"]).count() == 0


def test_terms(spark, rows):
    random.seed(3)
    # One pair and one term are very hot, terms have ties, nulls, empty and long forms.
    data = [("hot", "r0", 1)] * 4000 + [(random.choice(["a", "b", "", "长" * 3000, None, "hot"]), random.choice(["r0", "r1", "r2", None]), random.choice([0, 1, 2, None, -3])) for _ in range(2000)]
    data += [("zero", "r9", 0), ("zero", "r9", None)]
    df = spark.createDataFrame(data, "t string, r string, n int").withColumnRenamed("n", "count")
    occurrences, records = Counter(), defaultdict(set)
    for t, r, n in data:
        if t is not None:
            occurrences[t] += max(n or 0, 0)
            if (n or 0) > 0:
                records[t].add(r)
    want = sorted(((t, n, len(records[t])) for t, n in occurrences.items()), key=lambda x: str(x))
    assert sorted(rows(terms.term_counts(df.repartition(7), "t", "r", "count")), key=lambda x: str(x)) == want
    marks = {r.term: r.mark for r in terms.marked_terms(df, "t", "r", "count").collect()}
    assert marks["zero"] is None and marks["hot"] == "common"
    assert terms.term_counts(df.limit(0), "t", "r", "count").count() == 0
    assert rows(terms.term_counts(df.where("t = 'a'"), "t", "r"))[0][1] == sum(t == "a" for t, _, _ in data)


def check_sketch(sketch, values):
    values = np.sort(values)
    shares = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    for share, got in zip(shares, sketch.quantiles(shares)):
        rank = max(1, math.ceil(share * len(values) - 1e-9))
        lo, hi = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
        assert lo - sketch.error <= rank <= hi + sketch.error
    assert sketch.error <= 0.03 * len(values)


def test_sketch():
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=50_000), np.arange(30_000.0), np.arange(30_000.0)[::-1].copy(), np.repeat(5.0, 20_000), rng.pareto(1, 40_000)):
        whole = quantiles.Sketch(256, 8)
        whole.add(values)
        check_sketch(whole, values)
        merged = quantiles.Sketch(256, 8)
        for part in np.array_split(values, 13):
            one = quantiles.Sketch(256, 8)
            one.add(part)
            merged.merge(quantiles.Sketch.from_bytes(one.to_bytes()))
        assert merged.n == len(values)
        check_sketch(merged, values)
    small = quantiles.Sketch()
    small.add(np.array([3.0, 1.0, 2.0]))
    assert small.quantiles([0.5, 1.0]) == [2.0, 3.0] and small.error == 0
    assert quantiles.Sketch().quantiles([0.5]) == [None]


def test_percentiles(spark):
    random.seed(4)
    data = [(random.choice(["a", "b", None]), random.choice([random.random(), None, float("nan"), 0.5])) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.grp: r for r in quantiles.group_percentiles(df, "g", "v", [0.5, 0.9], 64, 4).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        values = np.sort([v for k, v in data if k == g and v is not None and not math.isnan(v)])
        assert r.n == len(values)
        for share, x in ((0.5, r.p50), (0.9, r.p90)):
            rank = math.ceil(share * r.n)
            assert np.searchsorted(values, x, "left") + 1 - r.rank_error <= rank <= np.searchsorted(values, x, "right") + r.rank_error
    assert quantiles.group_percentiles(df.limit(0), "g", "v", [0.5]).count() == 0


ENTRIES = ["票据核验专员", "应付往来会计", "跨境清结算员", "ETL调度工程师", "湖仓建模工程师", "Café渠道督导", "SRE值班工程师"]


def test_matching(spark, rows):
    reference = spark.createDataFrame(list(enumerate(ENTRIES, 1)), "ref_id bigint, entry string")
    around = [("急聘", ""), ("", "（内推）"), ("高薪诚聘", "-北汐"), ("资深", " MJ123456")]
    values = [f"{a}{e}{b}" for e in ENTRIES for a, b in around]
    typed = {"票核验专员": 1, "急聘票据合验专员（内推）": 1, "应付往会来计": 2, "资深跨境清结结算员 MJ99": 3, "ЕТL调度工程师": 4, "工程师（湖仓建模）": 5, "CAFE渠道督导": 6, "烘焙学徒": -1, "急聘月嫂（内推）": -1, "": -1, " ": -1, "—": -1, "货车司机（夜班）": -1}
    df = spark.createDataFrame([(i, v, "e") for i, v in enumerate([*values, *typed, *ENTRIES, None, "票核验专员"])], "id bigint, v string, entry string")
    got = {r.value: r.ref_id for r in map_values(df.selectExpr("v as value"), reference, "entry").collect()}
    assert {k: got[k] for k in typed} == typed
    assert all(got[f"{a}{e}{b}"] == i for i, e in enumerate(ENTRIES, 1) for a, b in around)
    out = rows(map_fields([(df, "id", "v", "f", reference, "entry")]))
    assert len(out) == len(values) + len(typed) + 1
    assert map_fields([(df.limit(0), "id", "v", "f", reference, "entry")]).count() == 0
    assert {r.ref_id for r in map_fields([(df, "id", "v", "f", reference.limit(0), "entry")]).collect()} == {-1}
    missed = rows(unmatched_values([(df, "id", "v", "f", reference, "entry")]))
    assert missed == sorted(("f", v, 1) for v, i in typed.items() if i == -1)


def test_matching_numbers_and_ways(spark):
    """Entries that differ in a digit only are different entries; similarities are real ones; an added word may be of any length."""
    reference = spark.createDataFrame([(1, "T1工程师"), (2, "T2工程师"), (3, "T3工程师"), (4, "仓库主管")], "ref_id bigint, entry string")
    long = "包吃住五险一金带薪年假节日福利定期体检全勤奖金"
    values = ["T2 工程师", "t3工程师", "T12工程师", f"T1工程师{long}", f"仓库主管{long}", f"仓主管{long}", "仓" * 30_000]
    got = {r.value: (r.ref_id, r.jaccard and round(r.jaccard, 3), r.way) for r in map_values(spark.createDataFrame([(v,) for v in values], "value string"), reference, "entry").collect()}
    assert got["T2 工程师"] == (2, 1.0, "holds") and got["t3工程师"] == (3, 1.0, "holds")
    assert got["T12工程师"] == (1, 0.667, "similar")
    assert got[f"仓库主管{long}"] == (4, round(4 / (4 + len(long)), 3), "holds")
    assert got[f"仓主管{long}"] == (4, 0.75, "similar")
    assert got["仓" * 30_000] == (-1, None, None)


def test_matching_against_brute_force(spark):
    """The join finds an entry of the greatest Jaccard among all entries for every value that has one of 0.5 or more."""
    from collections import Counter

    rng = np.random.default_rng(5)
    letters = list("甲乙丙丁戊己庚辛abcde")
    words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(400)]
    entries = sorted(set(words[:60]))
    values = sorted(set(words[60:]))
    listed = spark.createDataFrame([("x", i, e) for i, e in enumerate(entries)], "list string, ref_id bigint, entry string")
    forms = spark.createDataFrame([("x", v, v) for v in values], "list string, value string, form string")
    got = {r.value: r for r in similar_entries(forms, listed).collect()}

    def jaccard(a, b):
        a, b = Counter(a), Counter(b)
        return (a & b).total() / (a | b).total()

    assert len(got) > 30
    for v in values:
        best = max(jaccard(v, e) for e in entries)
        assert (v in got) == (best >= 0.5)
        if v in got:
            assert abs(got[v].jaccard - best) < 1e-9 and abs(jaccard(v, entries[got[v].ref_id]) - best) < 1e-9


def test_merge_of_many_sketches(spark):
    """More sketches of one group than a step takes: the tree's levels keep the bound, and the result is the same in any order."""
    rng = np.random.default_rng(7)
    values = rng.normal(size=40_000)
    rows = [("hot" if k % 3 else f"g{k % 5}", float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(40)
    parts = quantiles.sketch_column(df, "g", "v", size=16, fan=4)
    found = {}
    for sketches in (parts, parts.orderBy(F.desc(F.xxhash64("sketch")))):
        merged = quantiles.read_quantiles(quantiles.merge_sketches(sketches, fan_in=3), [0.1, 0.5, 0.9]).collect()
        found[len(found)] = sorted((r.grp, r.n, r.rank_error, r.p10, r.p50, r.p90) for r in merged)
    assert found[0] == found[1]
    for grp, n, error, *got in found[0]:
        own = np.sort([v for g, v in rows if g == grp])
        assert n == len(own) and 0 < error < n / 3
        for share, x in zip((0.1, 0.5, 0.9), got):
            rank = math.ceil(share * n)
            assert np.searchsorted(own, x, "left") + 1 - error <= rank <= np.searchsorted(own, x, "right") + error
