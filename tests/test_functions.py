from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bankflow.functions import (
    change_ratio,
    in_day,
    iso_text,
    mask_all,
    mask_but_last,
    month_range,
    parse_day,
    parse_month,
    risk_flag,
    rounded_ratio,
    safe_ratio,
    try_money,
    utilisation,
)
from bankflow.functions.dates import shift_month
from tests.helpers import plan_of, ts


def one(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_parse_day():
    assert parse_day("2025-08-01") == date(2025, 8, 1)
    for bad in ("2025-13-01", "01-08-2025", "2025-08-01 00:00", "", None):
        with pytest.raises(ValueError):
            parse_day(bad)
    with pytest.raises(ValueError):
        parse_month("2025-08-02")


def test_shift_month_over_year_end():
    assert shift_month(date(2025, 1, 1), -1) == date(2024, 12, 1)
    assert shift_month(date(2025, 12, 1), 1) == date(2026, 1, 1)


def test_in_day_is_half_open(spark):
    times = ["2025-08-01T00:00:00", "2025-08-01T23:59:59.999999", "2025-08-02T00:00:00",
             "2025-07-31T23:59:59.999999"]
    df = spark.createDataFrame([(ts(t),) for t in times], "t timestamp_ntz")
    assert df.filter(in_day("t", "2025-08-01")).count() == 2


def test_day_and_month_filters_reach_the_file(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for condition in (in_day("o_orderdate", "1998-03-02"), month_range("o_orderdate", "1998-03-01")):
        plan = plan_of(orders.filter(condition).select("o_orderkey"))
        assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize(
    "n, d, expected", [(10, -4, 2.5), (1, 0, None), (1, None, None), (None, 2, None)]
)
def test_safe_ratio(spark, n, d, expected):
    got = one(spark, "n double, d double", (n and float(n), d if d is None else float(d)),
              safe_ratio("n", "d"))
    assert got == expected


@pytest.mark.parametrize(
    "now, before, expected", [(70.0, 100.0, -0.3), (50.0, -100.0, 1.5), (5.0, 0.0, None)]
)
def test_change_ratio_uses_size_of_earlier_value(spark, now, before, expected):
    assert one(spark, "a double, b double", (now, before), change_ratio("a", "b")) == expected


@pytest.mark.parametrize(
    "balance, limit, positive, nonzero",
    [(50, 100, 0.5, 0.5), (50, 0, 0, 0), (50, None, 0, 0), (50, -100, 0, -0.5),
     (None, 100, 0, 0)],
)
def test_utilisation_guards(spark, balance, limit, positive, nonzero):
    schema, values = "b double, l double", tuple(
        v if v is None else float(v) for v in (balance, limit)
    )
    assert one(spark, schema, values, utilisation("b", "l")) == positive
    assert one(spark, schema, values, utilisation("b", "l", "nonzero")) == nonzero


@pytest.mark.parametrize(
    "used, pd, change, expected",
    [
        ("0.80", "0.30", "-0.30", False),
        ("0.8001", None, None, True),
        ("0", "0.3001", None, True),
        ("0", None, "-0.3001", True),
        ("0", None, None, False),
        (None, None, None, False),
    ],
)
def test_risk_flag_is_strict_and_never_null(spark, used, pd, change, expected):
    cast = [F.lit(v).cast("decimal(18,6)") for v in (used, pd, change)]
    assert spark.range(1).select(risk_flag(*cast).alias("x")).first()["x"] is expected


def test_text_helpers(spark):
    assert one(spark, "p string", ("081234567890",), mask_but_last("p")) == "********7890"
    assert one(spark, "p string", ("1234567890123456",), mask_all("p")) == "*" * 16
    assert one(spark, "p string", ("12x",), try_money("p")) is None
    df = spark.createDataFrame([(ts("2025-08-01T10:00:00.500000"),)], "t timestamp_ntz")
    assert df.select(iso_text("t")).first()[0] == "2025-08-01T10:00:00.5"


@pytest.mark.parametrize(
    "n, d, expected",
    [("1294.20", "408.91", "3.16"), ("0.01", "2.00", "0.01"), ("0.03", "2.00", "0.02"),
     ("5", "0", None), ("0", "3", "0.00"),
     ("12345678901234567890.12", "0.01", "1234567890123456789012.00")],
)
def test_rounded_ratio_rounds_once(spark, n, d, expected):
    cast = [F.lit(v).cast("decimal(25,2)") for v in (n, d)]
    got = spark.range(1).select(rounded_ratio(*cast, 2).alias("x")).first()["x"]
    assert got == (None if expected is None else Decimal(expected))
