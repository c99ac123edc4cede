import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.dictionaries import Role, Rule, TitleSpec
from evidex.functions import text as T
from evidex.operators import classify, dedupe, features, scoring, similarity

SPEC = TitleSpec(("高级", "中高级", "中高", "急招"), ("岗位", "岗", "双休"), {"风险专员": "风控专员"})


TITLES = [
    ('急招高级Java工程师岗', 'java工程师'),
    ('中高级中高级测试岗岗位', '级测试'),
    ('风险专员（总部）MJ002455', '风控专员'),
    ('高级岗', '高级'),
    ('（全部括号）', '（全部括号）'),
    ('未闭合（括号', '未闭合'),
    ('很长的岗位名称超过十二个字-北京分部', '很长的岗位名称超过十二个字'),
    (' 全角\u3000空格 ', '全角空格'),
    ('', ''),
    (None, ''),
    ('岗位', '岗位'),
    ('中高岗双休岗', '岗双休'),
    ("x" * 5000, "x" * 5000),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(TITLES)], "i int, t string")
    got = [r.s for r in df.select("i", T.normalize_title(F.col("t"), SPEC).alias("s")).orderBy("i").collect()]
    assert got == [want for _, want in TITLES]


def test_ngrams(spark):
    got = spark.createDataFrame([("ab a",), ("abcde",), ("",)], "t string").select(T.char_wb_ngrams(F.col("t")).alias("g")).collect()
    assert got[0].g == [" a", "ab", "b ", " ab", "ab ", " ab ", " a", "a ", " a "]
    assert got[2].g == []
    assert len(got[1].g) == 6 + 5 + 4


def test_cleaning(spark):
    df = spark.createDataFrame([("未提及，一般本科",), (" 本科。 ",), ("N/A",), (None,), ("1. SQL、sql；；2、Excel  Git/未知",)], "t string")
    got = df.select(T.clean_scalar(F.col("t")).alias("s"), T.split_list(F.col("t")).alias("l")).collect()
    assert [r.s for r in got][:4] == [None, "本科", None, None]
    assert got[4].l == ["SQL", "2", "Excel", "Git"]
    assert got[3].l == []


def test_pay(spark):
    df = spark.createDataFrame([("10-15K·13薪",), ("10-15K",), ("300-500元/天",), ("5000-7000元/月",), ("面议",), (None,)], "t string")
    got = [r[0] for r in df.select(T.pay_median_k(F.col("t"))).collect()]
    assert [None if x is None else round(x, 4) for x in got] == [13.5417, 12.5, 8.7, 6.0, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])), max_size=12))
def test_keep_first(spark, data):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id bigint, k string, v int")
    want = {}
    for i, key in enumerate(data):
        want.setdefault(key, i)
    assert sorted(r.id for r in dedupe.keep_first(df, ["k", "v"], "id").collect()) == sorted(want.values())


def test_postings(spark, rows):
    cols = "row_id bigint, job_link string, company_name string, title string, location string, salary string, is_dispatch string"
    data = [(1, None, "c", "t", "上海·浦东", "1K", None), (2, None, "d", "t", "x", "1K", None), (3, "l", "c", "t", "上海·徐汇", "1K", "否"), (4, "m", "e", None, None, None, "是"), (5, "n", "e", "u", None, None, "否")]
    df = spark.createDataFrame(data, cols)
    # 2 shares the null link with 1, 3 the business key with 1, 4 is dispatched.
    assert rows(dedupe.clean_postings(df, "row_id").select("row_id", "city")) == [(1, "上海"), (5, None)]
    assert rows(dedupe.clean_postings(df.limit(0), "row_id")) == []


def test_rules_and_roles(spark):
    rules = (Rule("A", ("算法", "ai"), ("算法交易",), ("训练",)), Rule("B", ("交易",)))
    df = spark.createDataFrame([("算法交易员", "x"), ("ai算法", "x"), ("经理", "负责训练"), ("经理", "x")], "t string, d string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(classify.rule_class(F.col("t"), F.col("d"), rules)).collect()]
    assert got == [("B", "交易", "title"), ("A", "算法", "title"), ("A", "训练", "jd"), None]
    roles = (Role("r1", "会计", "java"), Role("r2", "会计|java"))
    got = [r[0] for r in spark.createDataFrame([("会计",), ("Java会计",), (None,), ("x",)], "t string").select(classify.claim_role(F.col("t"), roles)).collect()]
    assert got == ["r1", "r2", None, None]


def test_classify(spark):
    rules = (Rule("fin", ("account",)), Rule("dev", ("java",)))
    data = [(1, "accountant senior", "x"), (2, "java developer", "x"), (3, "accoun tant", "x"), (4, "zzz", "x"), (5, "developer", "x")]
    df = spark.createDataFrame(data, "id bigint, std_title string, text_all string")
    got = {r.id: (r.category, r.assign_method) for r in classify.classify(df, rules, "other", "id").collect()}
    assert got == {1: ("fin", "rule"), 2: ("dev", "rule"), 3: ("fin", "embedding_sim"), 4: ("other", "fallback"), 5: ("dev", "embedding_sim")}
    assert classify.classify(df.limit(0), rules, "other", "id").count() == 0


def test_scores(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", None)], "k string, v double")
    ranks = {r.k: r.r for r in df.select("k", scoring.average_rank(F.col("v")).alias("r")).collect()}
    assert (ranks["a"], ranks["b"], ranks["c"]) == (1.5, 3.0, 1.5)
    tiers = [r[0] for r in spark.createDataFrame([(70.0,), (69.9,), (40.0,), (0.0,), (None,)], "s double").select(scoring.tier(F.col("s"))).collect()]
    assert tiers == ["高替代风险", "中等替代风险", "中等替代风险", "低替代风险", None]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double").select(features.calibrate(F.col("v"))).collect()
    assert [r[0] for r in flat] == [50.0, 50.0]
    hours = {r.owner: round(r.after) for r in scoring.time_structure(spark.createDataFrame([("A", 56.0), ("C", 28.0), ("H", 16.0)], "owner string, share double")).collect()}
    assert hours == {"A": 21, "C": 39, "H": 40}


def test_spearman_brute(spark):
    data = [(float(i % 4), float((i * 7) % 5)) for i in range(20)]
    got = scoring.spearman(spark.createDataFrame(data, "a double, b double"), "a", "b").first()[0]

    def ranks(xs):
        return [sum(y > x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]

    import numpy as np

    a, b = zip(*data)
    assert abs(got - np.corrcoef(ranks(a), ranks(b))[0, 1]) < 1e-12


def test_cosine(spark):
    docs = spark.createDataFrame([("p:x", "alpha beta"), ("u:1", "alpha"), ("u:2", "qq")], "doc string, text string")
    w = similarity.tfidf(docs, "doc", "text")
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    best = similarity.best_match(w.where("doc like 'u:%'"), w.where("doc like 'p:%'"), ["p:x"]).collect()
    assert [(r.doc, r.match) for r in best] == [("u:1", "p:x")]


def test_cosine_argmax_brute(spark, rows, tmp_path):
    import math
    import random
    from collections import Counter

    from evidex.plans.core_queries import cosine_argmax

    rng = random.Random(5)
    words = ["red", "green", "olive", "tan", "navy", "blue", "it", "almond"]
    parts = [(k, " ".join(rng.sample(words, 3)), rng.choice(["BRASS", "STEEL", "TIN"])) for k in range(60)] + [(60, None, "TIN"), (61, "zq", None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))

    def grams(name):
        out = Counter()
        for w in (f" {w} " for w in (name or "").split()):
            out.update([w[i : i + n] for n in (2, 3, 4) if len(w) > n for i in range(len(w) - n + 1)] + [w] * (len(w) <= 4))
        return out

    docs = {k: grams(name) for k, name, _ in parts} | {t: sum((grams(name) for _, name, x in parts if x == t), Counter()) for t in ("BRASS", "STEEL", "TIN")}
    df = Counter(g for c in docs.values() for g in c)
    vectors = {}
    for d, c in docs.items():
        v = {g: n * (math.log((len(docs) + 1) / (df[g] + 1)) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[d] = {g: x / size for g, x in v.items()}
    want = {}
    for k, _, _ in parts:
        scores = {t: round(sum(x * vectors[t].get(g, 0) for g, x in vectors[k].items()), 9) for t in ("BRASS", "STEEL", "TIN")}
        best = min(scores, key=lambda t: (-scores[t], t))
        want[k] = (best, scores[best]) if scores[best] else (None, 0.0)
    got = {r.doc: (r.match, r.score) for r in cosine_argmax(spark, str(tmp_path)).collect()}
    assert {k: m for k, (m, _) in got.items()} == {k: m for k, (m, _) in want.items()}
    assert all(abs(got[k][1] - s) < 2e-6 for k, (_, s) in want.items())


def test_template_fill_whole(spark, rows, tmp_path):
    from evidex.plans.core_queries import template_fill

    texts = [(1, "长文" * 5000), (2, ""), (3, None), (4, "with {x} and $1 \\1 in it, longer than twenty")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(template_fill(spark, str(tmp_path))) == [(k, f"A {t} B") for k, t in texts if t is not None]


def test_kmeans_starts(monkeypatch):
    from evidex.plans import core_queries

    class Fit(Exception):
        pass

    def kmeans(df, features, k=3, starts=20, seed=42):
        raise Fit(k, starts)

    monkeypatch.setattr(core_queries, "category_dims", lambda spark, sf_dir: None)
    monkeypatch.setattr(scoring, "kmeans", kmeans)
    with pytest.raises(Fit) as fit:
        core_queries.kmeans_labels(None, "")
    assert fit.value.args == (3, 20)


def test_median(spark):
    import random
    import statistics

    random.seed(6)
    data = [(random.choice(["a", "b", None]), random.choice([1.0, 2.0, 2.0, 7.5, random.random(), None, float("nan")])) for _ in range(400)] + [("c", None), ("d", 3.0), ("e", 1.0), ("e", 2.0)]
    got = {r.k: r.m for r in features.exact_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "m").collect()}
    want = {}
    for k in "abde":
        want[k] = statistics.median([v for g, v in data if g == k and v is not None and v == v])
    assert got == want


def test_median_brute(spark):
    """Hot and small groups, ties, outliers, infinities and constants against sorted lists."""
    import random
    import statistics

    rng = random.Random(11)
    data = [("hot", rng.gauss(1e9, 1.0)) for _ in range(3000)] + [("wide", rng.choice([1e-9, 1.0, 1e300, -1e300, 5.0])) for _ in range(501)]
    data += [("ties", float(rng.randint(1, 4))) for _ in range(400)] + [("same", 7.0)] * 10 + [("one", 3.0)] + [("inf", x) for x in (float("inf"), 1.0, 2.0, 3.0)] + [("none", float("nan")), ("none", None), (None, 1.0)]
    got = {r.g: r.m for r in features.exact_median(spark.createDataFrame(data, "g string, v double"), ["g"], "v", "m").collect()}
    assert got == {g: statistics.median([v for k, v in data if k == g]) for g in ("hot", "wide", "ties", "same", "one", "inf")}


def test_keep_first_marks(spark, rows):
    """Nulls equal nulls of the same column only, a negative nought is nought, and texts that join alike differ."""
    data = [(1, "a", None, 0.0), (2, None, "a", 0.0), (3, "a", None, -0.0), (4, "a=", "b", 1.0), (5, "a", "=b", 1.0), (6, "!", None, 1.0), (7, None, None, 1.0), (8, None, None, 1.0), (None, "z", "z", 2.0)]
    df = spark.createDataFrame(data, "id bigint, a string, b string, x double")
    assert [r.id for r in dedupe.keep_first(df, ["a", "b", "x"], "id").orderBy("id").collect()] == [1, 2, 4, 5, 6, 7]


def test_strata(spark, rows):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(50)], "id bigint, s string")
    out = dedupe.stratified(df, F.col("s"), {"a": 2, "b": 3}, "id")
    assert rows(out.select("s", "id")) == [("a", 2), ("a", 4), ("b", 1), ("b", 3), ("b", 7)]
    hashed = dedupe.stratified(df, F.col("s"), {"a": 2, "b": 3}, "id", seed=42)
    assert hashed.count() == 5 and rows(hashed) == rows(dedupe.stratified(df.repartition(7), F.col("s"), {"a": 2, "b": 3}, "id", seed=42))
