from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.functions import columns as c
from tests.helpers import column, frame


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-31", date(2024, 1, 31)),
        ("31/01/2024", date(2024, 1, 31)),
        ("5/1/2024", date(2024, 1, 5)),
        ("2024", None),
        ("2024-05", None),
        ("2024-02-30", None),
        ("31/13/2024", None),
        ("junk", None),
        ("", None),
        (None, None),
    ],
)
def test_mixed_dates(spark, text, expected):
    assert column(spark, c.to_mixed_day("x"), text) == expected


@pytest.mark.parametrize(
    "text, expected", [("12", 12), ("3.7", 4), ("-2.5", -3), ("1e3", 1000), ("99999999999", None), ("x", None), ("", None)]
)
def test_integers(spark, text, expected):
    assert column(spark, c.to_int("x"), text) == expected


@pytest.mark.parametrize("text, expected", [(" 7 ", 7), ("+7", 7), ("007", 7), ("2147483647", 2147483647), ("2147483648", None), ("7.", 7), ("-0", 0), (".5", 1)])
def test_plain_integers_are_not_read_as_decimals(spark, text, expected):
    slow = F.round(F.col("x").try_cast("decimal(38,10)"), 0).try_cast("int")
    assert column(spark, c.to_int("x"), text) == column(spark, slow, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("12.345", Decimal("12.35")), ("1,5", None), ("99999999999", None), ("", None), ("-0.1", Decimal("-0.10"))],
)
def test_money(spark, text, expected):
    assert column(spark, c.to_decimal("x"), text) == expected


def test_flags(spark):
    assert [column(spark, c.to_flag("x"), v) for v in ("true", "f", "1", "maybe", None)] == [
        True,
        False,
        True,
        None,
        None,
    ]
    assert column(spark, c.to_flag_strict("x"), None) is None
    with pytest.raises(Exception, match="not a boolean: maybe"):
        column(spark, c.to_flag_strict("x"), "maybe")


def test_text_cleaning(spark):
    assert column(spark, c.seller_key("x"), " seller_0001 ") == "SELLER-0001"
    assert column(spark, c.upper_trim("x"), " br ") == "BR"
    assert column(spark, c.blank_to_null("x"), "   ") is None
    assert column(spark, c.blank_to_null("x"), " a ") == "a"


def test_calendar_differences_count_boundaries(spark):
    df = frame(
        spark,
        "a timestamp_ntz, b timestamp_ntz",
        (datetime(2024, 1, 31, 10, 59), datetime(2024, 1, 31, 11, 1)),
        (datetime(2024, 1, 31, 23, 59), datetime(2024, 2, 1, 0, 1)),
        (datetime(2024, 2, 1, 0, 1), datetime(2024, 1, 31, 23, 59)),
    )
    got = [tuple(r) for r in df.select(c.hours_crossed("a", "b"), c.days_between("a", "b"), c.months_crossed("a", "b")).collect()]
    assert got == [(1, 0, 0), (1, 1, 1), (-1, -1, -1)]


def test_measures(spark):
    df = frame(spark, "v decimal(12,2), ok boolean", (Decimal("1.10"), True), (Decimal("2.25"), None), (None, False))
    row = df.agg(c.mean("v"), c.money_sum("v"), c.flag_sum(F.col("ok")), c.ratio(F.sum("v"), F.lit(0))).first()
    assert tuple(row) == (3.35 / 2, Decimal("3.35"), 1, None)
