import json
import random
from datetime import datetime, timedelta

import pytest

from bankflow.operators.alerts import alert_counts, amount_alerts, frequency_alerts
from bankflow.operators.detectors import high_amount, high_frequency, multi_city, rolling_count
from bankflow.operators.rolling import hot_keys, key_counts, rolling_plain, rolling_totals
from bankflow.plans.fraud import fraud_alerts
from tests.helpers import d, dec, rows, ts

TXNS = (
    "txn_id string, account_id string, txn_date timestamp_ntz, amount decimal(15,2), status string"
)


def txns(spark, *items):
    return spark.createDataFrame(
        [(f"t{i}", a, ts(t), dec(x), s) for i, (a, t, x, s) in enumerate(items)], TXNS
    )


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame(
        [("a1", "c1"), ("a2", "c1"), ("b1", "c2")], "account_id string, customer_id string"
    )


@pytest.mark.parametrize("exclude_current", [False, True])
@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 0])
@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_rolling_equals_the_plain_frame(spark, exclude_current, hot_rows, slice_seconds):
    """One key holds most rows; many rows share an instant; some keys are NULL."""
    rng = random.Random(7)
    start = datetime(2025, 1, 1)
    data = [
        (
            rng.choice(["hot"] * 6 + ["k1", "k2", None]),
            i,
            start + timedelta(microseconds=rng.randrange(0, 40) * 500_000 + rng.choice([0, 0, 1])),
            dec(rng.randrange(0, 10_000)) / 100,
        )
        for i in range(300)
    ]
    df = spark.createDataFrame(
        data, "customer_id string, id int, txn_date timestamp_ntz, amount decimal(15,2)"
    )
    options = {"seconds": 5, "exclude_current": exclude_current}
    fast = rolling_totals(df, hot_rows=hot_rows, slice_seconds=slice_seconds, **options)
    assert rows(fast) == rows(rolling_plain(df, **options))


def test_hot_list_is_bounded(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [("c",)] * 10, "k string")
    counts = key_counts(df, "k")
    assert rows(hot_keys(counts, "k", hot_rows=5)) == [("a",), ("b",), ("c",)]
    # At most max_keys - 1 keys can hold more than a max_keys-th of all rows.
    assert rows(hot_keys(counts, "k", hot_rows=5, max_keys=3)) == [("a",)]
    assert rows(hot_keys(counts, "k", hot_rows=60)) == []


def test_frequency_bounds_and_peers(spark, accounts):
    t = txns(
        spark,
        ("a1", "2025-08-01T10:00:00", "1", "COMPLETED"),
        ("a2", "2025-08-01T10:30:00", "1", "COMPLETED"),
        ("a1", "2025-08-01T10:30:00", "1", "COMPLETED"),
        ("a1", "2025-08-01T10:40:00", "1", "FAILED"),
        ("a1", "2025-08-01T11:00:00", "1", "COMPLETED"),
        ("a1", "2025-08-01T11:00:00.000001", "1", "COMPLETED"),
        ("b1", "2025-08-01T10:30:00", "1", "COMPLETED"),
    )
    counted = rows(rolling_count(t, accounts).filter("customer_id = 'c1'"), "txn_count")
    # 10:00 is inside the hour of 11:00 and outside that of one microsecond later.
    assert [c for (c,) in counted] == [1, 3, 3, 4, 4]
    got = rows(high_frequency(t, accounts, min_count=4))
    assert got == [("c1", d("2025-08-01"), 4, ts("2025-08-01T11:00:00"))]


def test_frequency_over_midnight_counts_for_the_later_day(spark, accounts):
    t = txns(
        spark,
        *[("a1", f"2025-08-01T23:5{m}:00", "1", "COMPLETED") for m in range(4)],
        ("a1", "2025-08-02T00:10:00", "1", "COMPLETED"),
    )
    alerts = frequency_alerts(high_frequency(t, accounts)).collect()
    assert [(a["customer_id"], a["alert_type"], str(a["alert_date"])) for a in alerts] == [
        ("c1", "HIGH_FREQUENCY_1H", "2025-08-02")
    ]
    assert json.loads(alerts[0]["details_json"]) == {
        "max_transactions_in_1h": 5, "first_trigger_at": "2025-08-02T00:10:00",
    }


def test_high_amount_excludes_peers_warmup_and_the_limit_itself(spark, accounts):
    t = txns(
        spark,
        ("a1", "2025-01-01T00:00:00", "10", "COMPLETED"),
        ("a1", "2025-01-05T00:00:00", "-90", "COMPLETED"),
        ("a1", "2025-01-31T00:00:00", "-300", "COMPLETED"),
        ("a1", "2025-01-31T00:00:00", "150", "COMPLETED"),
        ("a1", "2025-03-15T00:00:00", "9999", "COMPLETED"),
        ("b1", "2025-01-20T00:00:00", "10", "COMPLETED"),
        ("b1", "2025-01-31T00:00:00", "30", "COMPLETED"),
        ("b1", "2025-02-01T00:00:00", "60.01", "COMPLETED"),
        ("b1", "2025-02-01T12:00:00", "1000", "PENDING"),
    )
    # c1: -90 falls into the first 30 days. On 31 January the mean of 10 and 90 is 50 and the two
    # rows of that instant do not see each other: 300 is above 150, and 150 is not. In March there
    # is nothing in the 30 days before. c2: 30 is not above three times 10, 60.01 is above 60.
    got = rows(high_amount(t, accounts), "customer_id", "txn_id", "amount", "avg_amount",
               "ratio_to_avg")
    assert got == [
        ("c1", "t2", dec("300.00"), dec("50.00"), dec("6.00")),
        ("c2", "t7", dec("60.01"), dec("20.00"), dec("3.00")),
    ]
    details = {
        json.loads(a["details_json"])["txn_id"]: json.loads(a["details_json"])
        for a in amount_alerts(high_amount(t, accounts)).collect()
    }
    assert details["t2"] == {
        "txn_id": "t2", "txn_date": "2025-01-31T00:00:00", "amount": 300.0,
        "avg_amount_30d": 50.0, "ratio_to_avg": 6.0,
    }


def test_zero_mean_gives_an_alert_without_ratio(spark, accounts):
    t = txns(
        spark,
        ("a1", "2025-01-01T00:00:00", "5", "COMPLETED"),
        ("b1", "2025-02-01T00:00:00", "0", "COMPLETED"),
        ("b1", "2025-02-02T00:00:00", "1", "COMPLETED"),
    )
    got = rows(high_amount(t, accounts), "txn_id", "ratio_to_avg")
    assert got == [("t2", None)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_detectors_do_not_depend_on_the_hot_limit(spark, accounts, hot_rows):
    rng = random.Random(3)
    t = txns(
        spark,
        *[
            (
                rng.choice(["a1", "a2", "b1"]),
                (datetime(2025, 1, 1) + timedelta(seconds=rng.randrange(0, 5_000_000))).isoformat(),
                str(rng.randrange(1, 500)),
                "COMPLETED",
            )
            for _ in range(200)
        ],
    )
    assert rows(high_amount(t, accounts, hot_rows=hot_rows)) == rows(high_amount(t, accounts))
    assert rows(high_frequency(t, accounts, 86_400, 4, hot_rows=hot_rows)) == rows(
        high_frequency(t, accounts, 86_400, 4)
    )


def test_multi_city_and_all_alerts(spark, accounts):
    t = txns(
        spark,
        *[("a1" if i % 2 else "a2", f"2025-08-01T0{i}:00:00", "1", "COMPLETED") for i in range(4)],
        ("a1", "2025-08-01T09:00:00", "1", "REVERSED"),
    )
    places = spark.createDataFrame(
        [("t0", "Solo"), ("t1", "Bandung"), ("t2", "Solo"), ("t3", "Ambon"), ("t4", "Medan")],
        "txn_id string, merchant_city string",
    )
    assert rows(multi_city(t, accounts, places)) == [
        ("c1", d("2025-08-01"), 3, ["Ambon", "Bandung", "Solo"])
    ]
    alerts = fraud_alerts(t, accounts, places, seconds=3 * 3600, min_count=4)
    assert rows(alert_counts(alerts)) == [
        ("HIGH_FREQUENCY_1H", 1), ("MULTI_CITY_1D", 1), (None, 2),
    ]
