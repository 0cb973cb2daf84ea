import math

import pytest
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.functions.exact import sums
from foliomill.functions.formula import floor_div, modulo, power, with_metric
from foliomill.functions.replies import has_null, single_json, unfence
from foliomill.functions.values import let, money, show_number, strip, within


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, dates",
    [
        ("due 2024-01-15, paid 1/5/24 and 01-15-2024", ["2024-01-15", "1/5/24", "01-15-2024"]),
        ("15 January 2024 or Feb 3, 2024 or march 4 2024", ["15 January 2024", "Feb 3, 2024", "march 4 2024"]),
        ("Feb 3, 2024 then 2024-05-06 then Feb 3, 2024", ["2024-05-06", "Feb 3, 2024"]),
        ("no date: 2024-1-5x, 12/2024", []),
        ("", []),
        (None, []),
    ],
)
def test_dates_by_notation_then_position(spark, text, dates):
    assert one(spark, X.extract_dates, text) == dates


@pytest.mark.parametrize(
    "text, amounts",
    [
        ("pay $1,234.56 or € 99 or £5", [1234.56, 99.0, 5.0]),
        ("usd 10, then 12.50 EUR, then $10", [10.0, 12.5]),
        ("$0 and $, and 7 gbp", [7.0]),
        ("1.2.3 USD", [2.3]),
        ("12.4M USD none, $12.4M", [12.4]),
        (None, []),
    ],
)
def test_amounts(spark, text, amounts):
    assert one(spark, X.extract_amounts, text) == amounts


def test_long_digit_run_is_linear(spark):
    assert one(spark, X.extract_amounts, "1" * 200_000) == []


def test_paragraphs_and_tokens(spark):
    assert one(spark, X.paragraphs, "  a\nb \n \t\n\n c \n\n\n ") == ["a\nb", "c"]
    assert one(spark, X.paragraphs, " \n ") == []
    assert one(spark, X.tokens, "Éa B-2 c_d") == ["a", "b", "2", "c", "d"]
    assert one(spark, lambda c: X.window(c, 3), "añ😀bc") == "añ😀"
    assert one(spark, strip, "\t  x \x1f\n") == "x"


def test_unfence(spark):
    fenced = 'x ```json\n{"a": 1}\n``` y'
    assert one(spark, unfence, fenced) == 'x {"a": 1} y'
    assert one(spark, lambda c: unfence(c, strict=False), fenced) == '{"a": 1}'
    for text, ok in [('{"a": 1}', True), ('{"a": 1} x', False), ('{"a":1}{"a":2}', False), ('{"a":1},{"a":2}', False), ("[1]", False)]:
        assert one(spark, single_json, text) is ok


def test_money(spark):
    assert str(one(spark, money, "1.5E3")) == "1500.0000000000"
    assert one(spark, money, "many") is None
    assert [one(spark, lambda c: show_number(money(c)), t) for t in ("2", "3.25", "10.10", "100")] == ["2.0", "3.25", "10.1", "100.0"]
    assert one(spark, lambda c: within(c, F.lit("10.01")), "10.00") is True
    assert one(spark, lambda c: within(c, F.lit("10.02")), "10.00") is False
    assert one(spark, lambda c: let(c, lambda x: F.concat(x, x)), "ab") == "abab"


def test_division_follows_the_divisor(spark):
    rows = spark.createDataFrame([(-7, 3), (7, -3), (7, 0)], "a int, b int")
    out = rows.select(floor_div(F.col("a"), F.col("b")).alias("q"), modulo(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r.q, r.r) for r in out] == [(-3, 2), (-3, -2), (None, None)]
    assert rows.select(power(F.lit(2.0), F.col("b") * 1000)).first()[0] is None


def test_metric(spark):
    rows = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    out = with_metric(rows, "m", "try_divide(a, b) * 2 + abs(-1)").collect()
    assert [(r.m, r.m_error) for r in out] == [(5.0, False), (None, True), (None, False)]
    out = with_metric(rows.filter("a = 6"), "m", "a // 4 + a % 4 + b ** 2 + log(100, 10) + round(2.5) + round(3.14159, 2) + (-7) % 3").first()
    assert out.m == pytest.approx(1 + 2 + 9 + 2 + 2 + 3.14 + 2)
    for none in ("a / (b - b)", "a // (b - b)", "a % (b - b)", "pow(a, 2000)", "sqrt(-a)", "9e200 * 9e200"):
        assert [(r.m, r.m_error) for r in with_metric(rows.filter("a = 6"), "m", none).collect()] == [(None, True)]
    for bad in ("a.b", "a if b else a", "[a]", "abs(a, b, a)", "", "a; b", "exec(a)", "a + unknown"):
        with pytest.raises(ValueError):
            with_metric(rows, "m", bad)


def test_exact_sum(spark):
    total = lambda values: sums(spark.createDataFrame([(v,) for v in values], "v double"), [], {"total": F.col("v")}, {}).first().total
    assert total([4e-7] * 1000) == math.fsum([4e-7] * 1000)
    assert total([0.1] * 10 + [None]) == 1.0
    assert total([]) == 0.0 and total([None]) == 0.0
    assert math.isnan(total([1.0, float("nan"), 1.0]))
    assert total([1e25, 1.0]) == 1e25


def test_null_by_path(spark):
    paths = ("total", "terms.end", "lines[].qty")
    for text, found in [
        ('{"total": null}', True), ('{"total": 1, "more": {"total": null}}', False), ('{"terms": {"end": null}}', True),
        ('{"end": null}', False), ('{"lines": [{"qty": 1}, {"qty": null}]}', True), ('{"others": [{"qty": null}]}', False),
        ('{"lines": null}', False), ('{"note": "\\"total\\": null"}', False), ("no json", False), ("", False),
    ]:
        assert one(spark, lambda c: has_null(c, paths), text) is found, text
