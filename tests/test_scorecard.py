from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bankflow.operators.balances import latest_per_month, month_balance, with_previous
from bankflow.operators.scaffold import assemble_month, customer_months, report_months
from bankflow.operators.scores import asof_latest, scores_before
from bankflow.plans.scorecard import order_scorecard, rank_scorecard, scorecard, scorecard_month
from parity import queries
from parity.fixtures import Bank, ensure_shared_folder
from tests.helpers import d, dec, plan_of, rows, ts

SNAPSHOTS = (
    "snapshot_date date, account_id string, customer_id string, account_type string, "
    "balance decimal(15,2), credit_limit decimal(15,2)"
)


@pytest.fixture(scope="module")
def bank(spark):
    """Months 2025-01, 02 and 04; March is missing. c3 has no account."""
    customers = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "customer_id string")
    snapshots = spark.createDataFrame(
        [
            (d("2025-01-10"), "a1", "c1", "SAVINGS", dec("999"), None),
            (d("2025-01-31"), "a1", "c1", "SAVINGS", dec("100"), None),
            (d("2025-02-28"), "a1", "c1", "SAVINGS", dec("60"), None),
            (d("2025-04-30"), "a1", "c1", "SAVINGS", dec("90"), None),
            (d("2025-01-31"), "a2", "c1", "CREDIT_CARD", dec("0"), dec("100")),
            (d("2025-02-28"), "a2", "c1", "CREDIT_CARD", dec("10"), dec("0")),
            (d("2025-04-30"), "a2", "c1", "CREDIT_CARD", dec("81"), dec("100")),
            (d("2025-02-28"), "a3", "c2", "CREDIT_CARD", dec("5"), dec("-10")),
            (d("2025-04-30"), "a3", "c2", "CREDIT_CARD", dec("5"), None),
            (d("2025-04-30"), "a9", "gone", "SAVINGS", dec("5"), None),
        ],
        SNAPSHOTS,
    )
    accounts = spark.createDataFrame(
        [("a1", "c1"), ("a2", "c1"), ("a3", "c2")], "account_id string, customer_id string"
    )
    txns = spark.createDataFrame(
        [
            ("a1", ts("2025-01-05T10:00:00"), "DEBIT", dec("-10.01"), "WEB", "COMPLETED"),
            ("a2", ts("2025-01-31T23:59:59.999999"), "CREDIT", dec("0.04"), "WEB", "COMPLETED"),
            ("a1", ts("2025-02-01T00:00:00"), "FEE", dec("-1"), "QRIS", "FAILED"),
            ("a3", ts("2025-03-05T00:00:00"), "PAYMENT", dec("-7"), "QRIS", "COMPLETED"),
            ("a3", ts("2025-04-05T00:00:00"), "PAYMENT", dec("-7"), "OTHER", "COMPLETED"),
            ("zz", ts("2025-04-05T00:00:00"), "DEBIT", dec("-7"), "WEB", "COMPLETED"),
        ],
        "account_id string, txn_date timestamp_ntz, txn_type string, amount decimal(15,2), "
        "channel string, status string",
    )
    scores = spark.createDataFrame(
        [
            ("s1", "c1", d("2024-11-30"), dec("0.9")),
            ("s2", "c1", d("2025-02-28"), None),
            ("s3", "c1", d("2025-03-15"), dec("0.2")),
            ("s4", "c1", d("2025-05-01"), dec("0.9")),
            ("s5", "c3", d("2025-04-30"), dec("0.31")),
        ],
        "score_id string, customer_id string, score_date date, "
        "probability_of_default decimal(5,4)",
    )
    return customers, snapshots, accounts, txns, scores


def card_rows(df, *columns):
    return {(str(r["month_start"])[:7], r["customer_id"]): tuple(r[c] for c in columns)
            for r in df.collect()}


def test_every_customer_in_every_month(bank):
    got = order_scorecard(scorecard(*bank)).collect()
    assert [(str(r[0])[:7], r[1]) for r in got] == [
        (m, c) for m in ("2025-01", "2025-02", "2025-04") for c in ("c1", "c2", "c3")
    ]


def test_balances_changes_and_gap(bank):
    got = card_rows(
        scorecard(*bank), "total_balance", "previous_month_balance", "mom_balance_change_pct"
    )
    assert got["2025-01", "c1"] == (dec("100.00"), None, None)
    assert got["2025-02", "c1"] == (dec("70.00"), dec("100.00"), dec("-0.300000"))
    # The month before in the data is February.
    assert got["2025-04", "c1"] == (dec("171.00"), dec("70.00"), dec("1.442900"))
    # On the scaffold a month without accounts is a zero, so the ratio is NULL.
    assert got["2025-02", "c2"] == (dec("5.00"), dec("0.00"), None)
    assert got["2025-04", "c3"] == (dec("0.00"), dec("0.00"), None)


def test_utilisation_scores_and_flag(bank):
    got = card_rows(
        scorecard(*bank), "credit_utilization", "probability_of_default", "risk_flag"
    )
    assert got["2025-01", "c1"] == (dec("0"), dec("0.9000"), True)
    # The newest score has no probability, and it still replaces the older one.
    assert got["2025-02", "c1"] == (dec("0"), None, False)
    assert got["2025-04", "c1"] == (dec("0.810000"), dec("0.2000"), True)
    assert got["2025-02", "c2"] == (dec("0"), None, False)
    assert got["2025-02", "c3"] == (dec("0"), None, False)
    assert got["2025-04", "c3"] == (dec("0"), dec("0.3100"), True)


def test_activity(bank):
    got = card_rows(
        scorecard(*bank), "debit_count", "credit_count", "fee_count", "payment_count",
        "avg_web_amount", "avg_qris_amount",
    )
    # The mean 5.025 is rounded away from zero.
    assert got["2025-01", "c1"] == (1, 1, 0, 0, dec("5.03"), None)
    assert got["2025-02", "c1"] == (0, 0, 0, 0, None, None)
    assert got["2025-04", "c2"] == (0, 0, 0, 1, None, None)


def test_month_equals_full_where_the_month_before_exists(bank):
    full = scorecard(*bank).filter(F.col("month_start") == F.lit(d("2025-02-01")))
    month = scorecard_month(*bank, "2025-02-01")
    drop = ("credit_utilization", "mom_balance_change_pct")
    assert rows(full.drop(*drop)) == rows(month.drop(*drop))
    assert [t for _, t in month.dtypes] == [t for _, t in full.dtypes]
    # A negative limit counts in the monthly load only.
    used = card_rows(month, "credit_utilization")
    assert used["2025-02", "c2"] == (dec("-0.500000"),)
    assert used["2025-02", "c1"] == (dec("0"),)


def test_month_after_a_gap_has_no_previous(bank):
    got = card_rows(
        scorecard_month(*bank, "2025-04-01"), "previous_month_balance", "total_balance"
    )
    assert got["2025-04", "c1"] == (None, dec("171.00"))
    assert scorecard_month(*bank, "2025-03-01").count() == 0


def test_previous_by_window_and_by_moved_rows_agree(bank):
    customers, snapshots, *_ = bank
    grid = assemble_month(
        customer_months(customers, report_months(snapshots)), month_balance(snapshots)
    ).withColumn("total_balance", F.coalesce("total_balance", F.lit(0)).cast("decimal(20,2)"))
    by_window = with_previous(grid).select(
        "month_start", "customer_id", F.col("previous_month_balance").cast("decimal(20,2)")
    )
    assert rows(by_window) == rows(
        scorecard(*bank).select("month_start", "customer_id", "previous_month_balance")
    )


def test_asof_methods_agree_with_brute_force(bank):
    _, snapshots, _, _, scores = bank
    months = report_months(snapshots)
    brute = {}
    for r in scores_before(scores, months).orderBy("score_date").collect():
        brute[r["month_start"], r["customer_id"]] = (r["score_date"], r["probability_of_default"])
    for method in ("interval", "rank"):
        got = {
            (r["month_start"], r["customer_id"]): (r["score_date"], r["probability_of_default"])
            for r in asof_latest(scores, months, method).collect()
        }
        assert got == brute


def test_latest_snapshot_settles_ties(spark):
    day = d("2025-01-31")
    df = spark.createDataFrame(
        [(day, "a", "c", "SAVINGS", dec(b), None) for b in ("1", "3", "2")], SNAPSHOTS
    )
    assert [r["balance"] for r in latest_per_month(df).collect()] == [dec("3.00")]


def physical(df):
    return plan_of(df).split("== Physical Plan ==")[1]


def test_rank_form_moves_no_pairs(bank):
    """The pairs of scores and months are listed behind the last shuffle and sort."""
    _, snapshots, _, _, scores = bank
    plan = physical(asof_latest(scores, report_months(snapshots), method="rank"))
    assert "Generate" in plan and plan.index("Generate") < min(plan.index("Exchange"), plan.index("Sort"))


def test_rank_form_equals_interval_form_on_odd_rows(spark, bank):
    months = report_months(bank[1])
    odd = spark.createDataFrame(
        [
            (None, d("2025-01-01"), dec("0.1")), (None, d("2025-03-01"), None), ("c1", None, dec("0.2")),
            ("c2", d("2025-02-03"), dec("0.3")), ("c2", d("2025-02-03"), dec("0.4")), ("c2", d("2025-02-03"), None),
            ("c2", d("2025-04-30"), None), ("c3", d("2025-05-01"), dec("0.5")), (None, None, None),
        ],
        "customer_id string, score_date date, probability_of_default decimal(5,4)",
    )
    columns = ("month_start", "customer_id", "score_date", "probability_of_default")
    found = rows(asof_latest(odd, months, method="rank"), *columns)
    assert found == rows(asof_latest(odd, months), *columns)
    assert [r[2:] for r in found if r[1] == "c2"] == [
        (d("2025-02-03"), dec("0.4000")), (d("2025-04-30"), None)
    ]


def test_customer_leads_the_key_of_the_scorecard(bank):
    """Sorts by customer first hardly tie; sorts by month first tie on nearly every row."""
    plan = physical(scorecard(*bank))
    assert "hashpartitioning(customer_id" in plan and "hashpartitioning(month_start" not in plan


def test_balance_ratios_stand_below_the_joins(bank):
    """They are taken once per balance row, not on every row of the grid."""
    plan = physical(scorecard(*bank))
    assert "round(" not in plan[: plan.index("Join")]


def test_risk_flags_join_before_the_window(bank):
    customers, snapshots, _, _, scores = bank
    plan = physical(queries.risk_flag_months(SimpleNamespace(customers=customers, snapshots=snapshots, scores=scores)))
    assert plan.index("Window") < plan.index("Join")


def test_ranking_computes_the_report_once(spark, bank):
    ensure_shared_folder(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(customer):
        seen.add(1)
        return customer

    grid = customer_months(bank[0], report_months(bank[1]))
    counted = grid.withColumn("customer_id", F.udf(count, "string").asNondeterministic()("customer_id"))
    assert [r["row_number"] for r in rank_scorecard(counted).orderBy("row_number").collect()] == list(range(1, 10))
    assert seen.value == 9


def test_stored_tables_are_read_back(spark, bank, tmp_path):
    made = Bank(spark, str(tmp_path))
    made.scores = bank[4].groupBy("customer_id", "score_date").agg(F.max("probability_of_default").alias("p"))
    before = rows(made.scores)
    made.store("scores")
    assert rows(made.scores) == before and "Aggregate" not in physical(made.scores)
