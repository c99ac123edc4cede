import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.functions.codepoints import from_codepoints, to_codepoints
from evidex.llm.forms import APART, HAN, LOOKALIKES, MIXED, SPACE, UNSEEN, WIDE, normalize, normalize_strings, unify_text


def one(text):
    cps, ends, kinds = normalize(*to_codepoints(pa.array([text])))
    return from_codepoints(cps, ends).to_pylist()[0], int(kinds[0])


@pytest.mark.parametrize("unseen", ["\U000e0001", "\U000e0020", "\U000e007f", "\U000e0100", "\U000e01ef"])
def test_unseen_upper_planes(unseen):
    assert one(f"票{unseen}据") == ("票据", UNSEEN)
    assert one("\U00020000\U00030000\U000f0000") == ("\U00020000\U00030000\U000f0000", 0)


@pytest.mark.parametrize(
    "text, form, kinds",
    [
        ("ＳＱＬ１", "SQL1", WIDE),
        ("中　文 a", "中 文 a", SPACE),
        ("Café", "Café", APART),
        ("ậ", "ậ", APART),
        ("票​据﻿­", "票据", UNSEEN),
        ("ЅRE值班", "SRE值班", MIXED),
        ("В端", "B端", MIXED),
        ("Ꭱust", "Rust", MIXED),
        ("Пeреводчик", "Переводчик", MIXED),
        ("⼯程", "工程", HAN),
        ("理工", "理工", HAN),
        ("ﬁn", "fin", WIDE),
        ("俄语 Переводчик（！）", "俄语 Переводчик（！）", 0),
        ("Émile\tñ\n", "Émile\tñ\n", 0),
        ("ΑΒΓ", "ΑΒΓ", 0),
        ("", "", 0),
    ],
)
def test_cases(text, form, kinds):
    assert one(text) == (form, kinds)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), min_size=1, max_size=8))
def test_rows_are_apart(values):
    values = [None if v is None else v.encode("utf-8", "replace").decode() for v in values]
    together = normalize_strings(values)
    assert together == [None if v is None else one(v)[0] for v in values]
    assert [one(v)[0] for v in together if v is not None] == [v for v in together if v is not None]


def test_against_row_at_a_time():
    """Spaces, unseen and wide characters and marks, by plain Python."""
    random.seed(5)
    latin = {v for v in LOOKALIKES.values()}
    alphabet = [*"abé数据 \t", "　", "​", "Ａ", "９", "́", "̈", "⼯", "！"]
    for _ in range(500):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 20)))
        out = []
        for c in text:
            if unicodedata.category(c) == "Cf":
                continue
            out.append(" " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFKC", c) if c in "Ａ９⼯" else c)
        assert one(text)[0] == unicodedata.normalize("NFC", "".join(out)), (text, latin)


def test_slices_and_long():
    array = pa.array(["aＡ", None, "长" * 200_000, ""]).slice(1)
    cps, ends = to_codepoints(array)
    assert np.diff(ends).tolist() == [0, 200_000, 0]


def test_frame(spark, rows):
    data = [(1, "ＡB", "x"), (1, "ＡB", "x"), (2, None, "y"), (3, "", "z"), (None, "ok", "n")]
    df = spark.createDataFrame(data, "id bigint, t string, unified string")
    out = unify_text(df, {"f": "t"}, "id")
    assert rows(out.where("kinds > 0").select("record_id", "unified")) == [(1, "AB"), (1, "AB")]
    assert out.count() == 4 and unify_text(df.limit(0), {"f": "t"}, "id").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aeAâạậ̣̖́̂̀한가각ொö x", max_size=12), min_size=1, max_size=5))
def test_composition_is_canonical(values):
    """Marks in any order come out as Unicode's composed canonical form."""
    from evidex.functions.codepoints import row_of
    from evidex.llm.forms import _compose

    cps, offsets = to_codepoints(pa.array(values))
    out, rows, _ = _compose(cps, row_of(offsets))
    got = ["".join(map(chr, out[rows == k])) for k in range(len(values))]
    assert got == [unicodedata.normalize("NFC", v) for v in values]


def test_equal_looking_marks():
    forms = {one(x)[0] for x in ("ậ", "ậ", "ậ", "ậ", "ậ")}
    assert forms == {"ậ"}
    assert one("한") == ("한", APART)
    assert one("é̖")[0] == "é̖"
    assert one("a" + "̣̂" * 500)[0] == unicodedata.normalize("NFC", "a" + "̣̂" * 500)


def test_lone_stand_ins():
    assert one("Β I看板") == ("B I看板", MIXED) and one("Ε RP‎总账") == ("E RP总账", MIXED | UNSEEN)
    assert one("Java с нами") == ("Java с нами", 0) and one("Β  I") == ("Β  I", 0) and one("Β 看板") == ("Β 看板", 0)
