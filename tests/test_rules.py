import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from bankflow.operators import rules
from bankflow.operators.clean import clean_transactions
from bankflow.operators.previous import previous_row
from bankflow.plans.lineage import trace_upstream
from tests.helpers import d, dec, rows


def test_previous_row_matches_brute_force(spark):
    """One key holds most rows, and parts are skipped."""
    rng = random.Random(5)
    days = {
        (rng.choice(["hot"] * 5 + ["k1", "k2"]), date(2024, 1, 1) + timedelta(rng.randrange(900)))
        for _ in range(400)
    }
    data = [(k, day, i if i % 7 else None) for i, (k, day) in enumerate(sorted(days))]
    df = spark.createDataFrame(data, "k string, day date, v int")
    got = rows(previous_row(df, "k", ["day"], ["v", "day"], F.trunc("day", "month")))
    expected, last = [], {}
    for k, day, v in data:
        expected.append((k, day, v, *last.get(k, (None, None))))
        last[k] = (v, day)
    assert got == sorted(expected, key=repr)


def test_balance_breaks(spark):
    data = [
        ("a", d("2025-01-30"), dec("10"), dec("0")),
        ("a", d("2025-01-31"), dec("15"), dec("5")),
        ("a", d("2025-02-01"), dec("20"), dec("4")),
        ("a", d("2025-02-03"), dec("99"), dec("0")),
    ]
    df = spark.createDataFrame(
        data, "account_id string, snapshot_date date, balance decimal(15,2), "
        "daily_net_amount decimal(15,2)"
    )
    assert rows(rules.balance_breaks(df), "snapshot_date", "difference") == [
        (d("2025-02-01"), dec("1.00"))
    ]
    assert rules.balance_breaks(df, consecutive_days=False).count() == 2


def test_score_jumps(spark):
    df = spark.createDataFrame(
        [("c", d("2025-01-01"), 500), ("c", d("2025-03-01"), 600), ("c", d("2025-03-02"), 499),
         ("e", d("2025-03-02"), 850)],
        "customer_id string, score_date date, credit_score int",
    )
    assert rows(rules.score_jumps(df)) == [("c", d("2025-03-02"), 499, 600)]


def test_sign_violations(spark):
    df = spark.createDataFrame(
        [("CREDIT", -1), ("CREDIT", 1), ("DEBIT", 1), ("PAYMENT", 1), ("PAYMENT", -1), ("FEE", 0)],
        "txn_type string, amount int",
    )
    assert rows(rules.sign_violations(df)) == [
        ("CREDIT", 2, 1), ("DEBIT", 1, 1), ("FEE", 1, 0), ("PAYMENT", 2, 0)
    ]


def test_fee_interest_and_features(spark):
    snapshots = spark.createDataFrame(
        [
            (d("2025-01-05"), "a", "c", "SAVINGS", dec("5"), None),
            (d("2025-01-31"), "a", "c", "SAVINGS", dec("1000000"), None),
            (d("2025-01-31"), "b", "c", "SAVINGS", dec("999999.99"), None),
            (d("2025-01-31"), "l", "c", "LOAN", dec("1"), None),
        ],
        "snapshot_date date, account_id string, customer_id string, account_type string, "
        "balance decimal(15,2), credit_limit decimal(15,2)",
    )
    assert rows(rules.savings_fee(snapshots)) == [(d("2025-01-01"), 1, 10_000)]
    loans = spark.createDataFrame(
        [("l", "c", "LOAN", dec("1200"), dec("0.1")), ("s", "c", "SAVINGS", dec("1"), dec("0.1"))],
        "account_id string, customer_id string, account_type string, balance decimal(15,2), "
        "interest_rate decimal(5,4)",
    )
    assert rows(rules.loan_interest(loans), "monthly_interest") == [(dec("10.00000000"),)]
    scores = spark.createDataFrame(
        [("s1", '{"k": 3}'), ("s2", "broken")], "score_id string, features_used string"
    )
    assert rows(rules.score_features(scores, "k int")) == [("s1", 3), ("s2", None)]


def test_customer_rules(spark):
    customers = spark.createDataFrame(
        [("v", "VERIFIED", d("2025-01-01"), "1", "081234"),
         ("p", "PENDING", d("2025-01-01"), "1", "081235"),
         ("q", "PENDING", d("2025-01-02"), "2", "081235"),
         ("r", "REJECTED", d("2025-01-01"), None, None)],
        "customer_id string, kyc_status string, registration_date date, nik string, phone string",
    )
    accounts = spark.createDataFrame(
        [("av", "v", "ACTIVE"), ("ap", "p", "ACTIVE"), ("aq", "q", "CLOSED"),
         ("ar", "r", "ACTIVE")],
        "account_id string, customer_id string, status string",
    )
    txns = spark.createDataFrame([("ar",), ("ar",), ("av",)], "account_id string")
    assert rows(rules.active_not_verified(accounts, customers), "account_id") == [("ap",), ("ar",)]
    assert rows(rules.kyc_overdue(customers, d("2025-02-01")), "customer_id") == [("p",)]
    assert rows(rules.rejected_with_txns(txns, accounts, customers)) == [("r", 2)]
    assert rows(rules.duplicate_customers(customers, "nik")) == [("1", 2)]
    assert rows(rules.duplicate_customers(customers, "phone")) == [("081235", 2)]
    assert rows(rules.mask_pii(customers), "phone")[0] == ("**1234",)


def test_clean_transactions(spark):
    good = ("t1", "a", "2025-01-01 10:00:00", "DEBIT", "-1.50", "WEB", "COMPLETED")
    later = ("t1", "a", "2025-01-01 11:00:00", "DEBIT", "-1.50", "WEB", "COMPLETED")
    bad = [
        ("t2", "a", "yesterday", "DEBIT", "x", "WEB", "COMPLETED"),
        (None, None, "2025-01-01 10:00:00", "LOAN", "1", None, "DONE"),
    ]
    raw = spark.createDataFrame(
        [good, later, good, *bad],
        "txn_id string, account_id string, txn_date string, txn_type string, amount string, "
        "channel string, status string",
    )
    valid, rejected = clean_transactions(raw)
    assert [(r["txn_id"], r["amount"], r["txn_date"].hour) for r in valid.collect()] == [
        ("t1", dec("-1.50"), 11)
    ]
    assert rows(rejected.filter("txn_id = 't2'"), "raw_amount", "raw_txn_date") == [("x", "yesterday")]
    reasons = {r["txn_id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {
        "t2": "txn_date is missing or unreadable; amount is missing or unreadable",
        None: "txn_id is missing; account_id is missing; txn_type is unknown; channel is unknown; "
        "status is unknown",
    }


def test_lineage_over_hops_branches_and_cycles(spark):
    edges = spark.createDataFrame(
        [
            ("ACCOUNTS", "BALANCE", "bronze.accounts", "balance"),
            ("bronze.accounts", "balance", "silver.snapshots", "balance"),
            ("silver.snapshots", "balance", "gold.scorecard", "total_balance"),
            ("gold.scorecard", "total_balance", "gold.scorecard", "risk_flag"),
            ("silver.snapshots", "balance", "gold.scorecard", "risk_flag"),
            ("gold.scorecard", "risk_flag", "bronze.accounts", "balance"),
            ("other", "x", "other", "y"),
        ],
        "source_table string, source_column string, target_table string, target_column string",
    )
    got = rows(trace_upstream(edges, "gold.scorecard", "risk_flag"))
    assert got == sorted(
        [
            ("gold.scorecard", "total_balance", 1),
            ("silver.snapshots", "balance", 1),
            ("bronze.accounts", "balance", 2),
            ("ACCOUNTS", "BALANCE", 3),
        ],
        key=repr,
    )
    assert trace_upstream(edges, "nowhere", "x").count() == 0
