import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.operators.segment import canonical, expected_counts, known_values, scan, unpack, unpack_all, value_frequencies, viterbi


def values(text):
    return [p[0] for p in scan(text)]


def test_notations():
    assert values("“C/C++”/接口/\"收单；清分\"/Git") == ["C/C++", "接口", "收单；清分", "Git"]
    assert values('["建模", "CTE与\\"窗口\\"查询"]') == ["建模", 'CTE与"窗口"查询']
    assert values("['a', 'b|c']") == ["a", "b|c"]
    assert values('"CTE与""窗口""查询"') == ['CTE与"窗口"查询']
    assert values("1、甲\n2、乙\n3、甲") == ["甲", "乙", "甲"]
    assert values("(1)甲 ; (2)“预算, 决算”") == ["甲", "预算, 决算"]
    assert values("* \"TCP/IP\"\n* 仓库") == ["TCP/IP", "仓库"]
    assert values("Power Query  Excel（高级函数）") == ["Power Query", "Excel（高级函数）"]
    assert values("5G、3D建模") == ["5G", "3D建模"]
    assert values("；； ,") == values("") == values("  ") == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc数据 ", min_size=1, max_size=6).map(str.strip).map(lambda s: " ".join(s.split())).filter(bool), min_size=1, max_size=6), st.sampled_from([",", "；", "|", "\t", "、", "\n", " / "]))
def test_round_trip_plain(items, sep):
    assert values(sep.join(items)) == items


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab,;/、 据\"", max_size=8).map(lambda s: f"a{s}b"), min_size=1, max_size=5))
def test_round_trip_quoted(items):
    assert values(";".join('"' + i.replace('"', '""') + '"' for i in items)) == items


def lattice(text, joined, model):
    """Edges of the pieces and of joined values (from, to), with the frequencies of a model."""
    pieces = scan(text)
    edges = [(i, i + 1, p[0]) for i, p in enumerate(pieces)] + [(i, j, canonical(text)[0] if j - i == len(pieces) else v) for i, j, v in joined]
    return [(i, j, v, model.get(v, 0.0)) for i, j, v in edges]


def test_model_decides():
    joined = [(0, 2, "C/C++")]
    assert viterbi(lattice("C/C++,Java", [], {}), 1.0) == ["C", "C++", "Java"]
    model = {"C/C++": 50.0, "Java": 50.0}
    assert viterbi(lattice("C/C++,Java", joined, model), 100.0) == ["C/C++", "Java"]
    assert viterbi(lattice("C/C++,Java", joined, {"C/C++": 1.0, "C": 60.0, "C++": 60.0}), 200.0) == ["C", "C++", "Java"]
    counts = expected_counts(lattice("C/C++,Java", joined, model), 100.0)
    assert counts["C/C++"] > 0.9 and abs(counts["Java"] - 1) < 1e-9


def test_lists_and_numbers():
    # A list's own separator parts its unquoted members, other ones stay inside them.
    assert values("[A/B测试, TCP/IP, 仓库]") == ["A/B测试", "TCP/IP", "仓库"]
    assert values("【甲；乙、丙】") == ["甲", "乙、丙"]
    assert values("[甲]") == ["甲"] and values("[]") == []
    assert values("1. Java 2. Go 3. SQL") == ["Java", "Go", "SQL"]
    assert values("1. Java 8. Go") == ["Java 8. Go"] and values("Java 2. Go") == ["Java 2. Go"]
    assert canonical("a / b,c") == ("a/b,c", "a/b", 3) and canonical("a") == ("a", "a", 1)


def test_more_values_than_any_bound(spark):
    """Known values of many parts, and more of them than a driver's table held before."""
    n = 30_000
    known = [(i, f'"k{i}/x{i}/y/z/u/v"') for i in range(n)] + [(n + i, f"k{i}/x{i}/y/z/u/v;w") for i in range(0, n, 1000)] + [(2 * n, "k1/x2/y")]
    df = spark.createDataFrame(known, "id bigint, t string")
    got: dict = {}
    for r in unpack(df, {"t": "t"}, "id").where(f"record_id >= {n}").orderBy("record_id", "pos").collect():
        got.setdefault(r.record_id, []).append(r.item)
    assert got == {n + i: [f"k{i}/x{i}/y/z/u/v", "w"] for i in range(0, n, 1000)} | {2 * n: ["k1", "x2", "y"]}


def test_frequency_decides_in_the_table(spark):
    """The same joined value is whole where it is the commoner reading, and in parts where its parts are."""
    rows = [(i, '"p/q"') for i in range(50)] + [(100 + i, "r") for i in range(40)] + [(200 + i, "s") for i in range(40)] + [(300, '"r/s"'), (400, "p/q"), (401, "r/s")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = {}
    for r in unpack(df, {"t": "t"}, "id").where("record_id >= 400").orderBy("record_id", "pos").collect():
        got.setdefault(r.record_id, []).append(r.item)
    assert got == {400: ["p/q"], 401: ["r", "s"]}


def test_frame(spark, rows):
    data = [(1, "a,b", '"x/y"'), (2, None, "x/y;z"), (3, "", '"x/y"'), (3, "q", '"x/y"'), (4, "a,b", "长" * 50_000)]
    df = spark.createDataFrame(data, "id bigint, f string, item string")
    out = rows(unpack(df, {"one": "f", "two": "item"}, "id"))
    assert ("one", 1, 1, "a") in out and ("one", 4, 2, "b") in out
    # The column knows x/y as one value, so the unquoted one stays whole.
    assert ("two", 2, 1, "x/y") in out and ("two", 2, 2, "z") in out
    assert ("two", 4, 1, "长" * 50_000) in out
    assert rows(unpack(df.limit(0), {"one": "f"}, "id")) == []
    assert known_values(value_frequencies(df.limit(0).selectExpr("f as text"))) == (None, 1.0)


def test_many_rows(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(30)]
    want = {i: [random.choice(words) for _ in range(random.randint(1, 6))] for i in range(300)}
    df = spark.createDataFrame([(i, random.choice([",", "；", "|", "\n"]).join(w)) for i, w in want.items()], "id bigint, t string")
    got: dict = {}
    for r in unpack_all([(df, {"t": "t"}, "id")]).orderBy("record_id", "pos").collect():
        got.setdefault(r.record_id, []).append(r.item)
    assert got == want
