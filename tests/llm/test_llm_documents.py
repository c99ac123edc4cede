import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.llm import leakage, quality, tokens
from evidex.llm.leakage import align, bare, leaks

VOCABULARY = tokens.VOCABULARY


@pytest.fixture(scope="module")
def enc():
    try:
        return tokens._encoding(tokens.load())
    except FileNotFoundError:
        pytest.skip("no vocabulary here")


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("数据ab工程 \n\t's1é，.　 ”"), max_size=200))
def test_encoding_is_exact(enc, text):
    assert tokens.encode_text(enc, text, 20, 12, 8) == enc.encode_ordinary(text)


def test_joins(enc):
    random.seed(7)
    for _ in range(500):
        data = "".join(random.choice("aabcdething数据的") for _ in range(random.randint(2, 300))).encode()
        at = random.randint(1, len(data) - 1)
        assert tokens.join(enc, tokens._piece(enc, data[:at]), tokens._piece(enc, data[at:]), 1) == tokens._piece(enc, data)


def test_corpus(spark, enc):
    texts = [None, "", " ", "Hello <|endoftext|> 世界", "a" * 5000, "数据工程治理" * 800, "x y\n" * 900, "a" * 5000, "。" * 3000]
    df = spark.createDataFrame([(i % 7, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text", long=1000, size=300, leaf=64).collect())
    assert got == sorted((i % 7, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def folded(text):
    return "".join(map(chr, bare(pa.array([text]))[0]))


def test_bare():
    assert folded("ＡＢc，１2 数。é①​") == "abc12数é"


@settings(max_examples=100, deadline=None)
@given(st.text("ab数", min_size=1, max_size=14), st.text("ab数", min_size=1, max_size=14))
def test_alignment(a, b):
    x, y = (np.array([ord(c) for c in t], np.uint32) for t in (a, b))
    h = np.zeros((len(y) + 1, len(x) + 1), int)
    run = np.zeros_like(h)
    for i in range(1, len(y) + 1):
        for j in range(1, len(x) + 1):
            same = y[i - 1] == x[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
            run[i, j] = run[i - 1, j - 1] + 1 if same else 0
    assert align(x, y) == (h.max(), run.max())


def test_leaks(spark, rows):
    random.seed(8)
    letters = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜abcdefgh123"

    def text(n):
        return "".join(random.choice(letters) for _ in range(n))

    items = [(i, text(random.randint(60, 150))) for i in range(20)] + [(20, "太短"), (21, None), (22, "重复" * 60)]
    hot = text(30)
    items += [(23, hot + text(60))]
    docs = []
    for d in range(200):
        body = text(200) + (hot if d % 3 == 0 else "")
        if d % 4 == 0:
            i, t = random.choice(items[:20])
            n = random.choice([49, 50, 55])
            at = random.randint(0, len(t) - n)
            body += "，".join(t[at : at + n].upper()) + text(50)
        docs.append((d, body, d))
    docs += [(900, None, 0), (901, "", 0), (902, "重复" * 5000, 0), (903, items[23][1], 0)]
    want = set()
    for d, body, _ in docs:
        f = folded(body) if body else ""
        for i, t in items:
            g = folded(t) if t else ""
            if any(g[k : k + 50] in f for k in range(len(g) - 49)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks(df, frame)
    assert {(r.doc_id, r.item_id) for r in found.where("longest_run >= 50").collect()} == want
    assert max(r.score for r in found.where("doc_id = 903").collect()) == 1.0
    assert leaks(df.limit(0), frame).count() == leaks(df, frame.limit(0)).count() == 0


def test_edited_copies(spark):
    rng = random.Random(30)
    items = {i: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) for i in range(40)}
    # One letter in every 30 to 49 is another; items from 20 on also stand unedited elsewhere.
    docs = [(i, "".join("x" if k % (30 + i % 20) == 29 else c for k, c in enumerate(t))) for i, t in items.items()]
    docs += [(100 + i, items[i]) for i in range(20, 40)]
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    scores = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    assert set(scores) == {(d, d % 100) for d, _ in docs}
    assert all(0.9 < scores[i, i] < 1 for i in items) and all(scores[100 + i, i] == 1 for i in range(20, 40))


def test_bare_upper_planes():
    import sys
    import unicodedata

    import pyarrow as pa

    unseen = "\U000e0001\U000e0041\U000e0100\U000e01ef\U000f0000\U0010fffd"
    flat, offsets = bare(pa.array([f"A{unseen}b\U00030000", unseen]))
    assert flat.tolist() == [97, 98, 0x30000] and offsets.tolist() == [0, 3, 3]
    assert not any(unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nd" for c in range(leakage.LETTERS_END, sys.maxunicode + 1))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SCAN_GRAMS", 100)
    items = spark.createDataFrame([(i, chr(0x4E00 + i) * 80) for i in range(5)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, chr(0x4E00 + i) * 60) for i in range(5)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items).where("longest_run >= 50").collect()) == [(i, i) for i in range(5)]


PROSE = ["项目组希望借助自助分析工具复核合同归档目录，以便满足内部检查的要求。", "如果你熟悉共享文档，并且愿意推动渠道投放，欢迎加入我们的团队。", "They moved from paper forms to a dashboard, and the result was better than we expected.", "It took three weeks, but the team said that the plan is a good place to start."]
ITEMS = ["Java", "Rust", "SQL", "数据清洗", "财务建模", "容器编排", "压力测试", "尽职调查"]


def made(kind):
    if kind == "prose":
        return random.choice(["", "\n"]).join(random.choice(PROSE) + " " for _ in range(random.randint(4, 12)))
    if kind == "list":
        return "\n".join(f"- {random.choice(ITEMS)}" for _ in range(random.randint(8, 25)))
    if kind == "table":
        return "\n".join(f"{random.choice(ITEMS)},{random.randint(1, 900)},{random.randint(3, 40)}K,{random.random() * 100:.2f}" for _ in range(random.randint(8, 25)))
    return random.choice(["哈" * random.randint(50, 200), "".join(random.choice("asdfghjkl;qwe ") for _ in range(300)), "".join(chr(random.randint(0x4E00, 0x6000)) for _ in range(200)), "=-" * 100])


def test_kinds(spark):
    random.seed(9)
    truth = {i: random.choice(["prose"] * 5 + ["list", "table", "junk"]) for i in range(900)}
    docs = [(i, made(k), "x") for i, k in truth.items()] + [(2000, None, "x"), (2001, "", "x"), (2002, " \n　", "x"), (2003, made("prose") * 300, "x")]
    # One label in twenty is wrong.
    labels = [(i, k if random.random() > 0.05 else "list") for i, k in truth.items() if i % 3 == 0] + [(5000, "junk"), (1, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, kind string")
    got = {r.doc_id: r.kind for r in quality.document_kinds(df, spark.createDataFrame(labels, "doc_id bigint, kind string")).collect()}
    assert set(got) == set(truth) | {2003} and got[2003] == "prose"
    held = [i for i in truth if i % 3]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.97
    assert quality.document_kinds(df.limit(0), spark.createDataFrame(labels, "doc_id bigint, kind string")).count() == 0


def test_statistics():
    model = np.zeros(quality.BUCKETS, np.uint8)
    texts = ["", "The team is here. It works!", "a b", None, "甲：1\n乙：2\n乙：2", "x" * 100_000]
    together = quality.statistics(pa.array(texts), model)
    apart = np.concatenate([quality.statistics(pa.array([t], pa.string()), model) for t in texts])
    assert np.allclose(together, apart) and not together[0].any() and not together[3].any()
    s = dict(zip(quality.STATISTICS, together[1]))
    assert s["word_count"] == 6 and abs(s["common_words"] - 3 / 6) < 1e-9 and abs(s["sentence_ratio"] ** 2 - 2 / 22) < 1e-9
    assert abs(together[4][quality.STATISTICS.index("repeated_lines")] - 1 / 3) < 1e-9
