from fractions import Fraction

import pytest

from evidex.operators.units import UNITS, chinese_number, convert, normalize_pay, parse_pay, parse_period, parse_unit


@pytest.mark.parametrize(
    "text, period, want",
    [
        ("10-15K·13薪", None, (10833, 16250)),
        ("8-9万/年", None, (6667, 7500)),
        ("7.5千-1.15万", None, (7500, 11500)),
        ("RMB 11,500–16,500/month", None, (11500, 16500)),
        ("九千至一万四/月", None, (9000, 14000)),
        ("六到八千", None, (6000, 8000)),
        ("300-500元/天", None, (6525, 10875)),
        ("1300元/周", None, (5633, 5633)),
        ("40-50元/小时", None, (6960, 8700)),
        ("23.5K以上", None, (23500, None)),
        ("17K以内", None, (None, 17000)),
        ("面谈（含奖金）", None, (None, None)),
        ("北汐·滨湖新城·云溪园4座", None, (None, None)),
        ("", None, (None, None)),
        (None, "月", (None, None)),
        ("15500", "月·13薪", (16792, 16792)),
        ("65元", "hour", (11310, 11310)),
        ("600元/天", "月", (13050, 13050)),
        ("1-2 3-4", None, (None, None)),
        ("15k-20k，五险一金", None, (15000, 20000)),
        ("月薪8000元，提成另算", None, (8000, 8000)),
        ("10-15K·13-15薪", None, (10833, 18750)),
        ("1万5", None, (15000, 15000)),
        ("1万5千", None, (15000, 15000)),
        ("1万5000元", None, (15000, 15000)),
        ("1万-1万5", None, (10000, 15000)),
        ("3000-5000元/双周", None, (6500, 10833)),
        # No unit of pay is named, so these are something else.
        ("3-5年，本科", None, (None, None)),
        ("100-499人", None, (None, None)),
        ("2万，3万", None, (None, None)),
    ],
)
def test_pay(text, period, want):
    assert parse_pay(text, period) == want


def test_numbers_and_units():
    assert chinese_number("一万四")[0] == 14000
    assert chinese_number("两万零五百")[0] == 20500
    assert chinese_number("一百二十万")[0] == 1200000
    assert parse_period("月薪（14薪）") == ("month", 14)
    assert parse_period("未提及") == (None, None)
    assert convert(36, parse_unit("km/h"), parse_unit("m/s")) == 10
    assert convert(90, parse_unit("kg*m/min"), parse_unit("kg*m/s")) == Fraction(3, 2)
    assert convert(100, parse_unit("°C"), UNITS["K"]) == Fraction(37315, 100)
    assert convert(32, parse_unit("°F"), parse_unit("°C")) == 0
    with pytest.raises(ValueError):
        convert(1, UNITS["kg"], UNITS["m"])


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "10K", None, "x"), (1, "10K", None, "x"), (2, None, "月", "y"), (3, "面议", None, "z"), (None, "5K", None, "n")], "id bigint, pay string, period string, field string")
    out = rows(normalize_pay(df, "id", "pay", "period", "f"))
    assert out == [("f", 1, "high", 10000)] * 2 + [("f", 1, "low", 10000)] * 2
    assert rows(normalize_pay(df.limit(0), "id", "pay")) == []
