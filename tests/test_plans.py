"""Plan shapes that matter at scale."""

import re

from bankflow.operators.balances import latest_per_month, month_balance_and_carried
from bankflow.operators.clean import clean_transactions
from bankflow.operators.detectors import high_frequency
from bankflow.operators.scaffold import report_months
from bankflow.operators.scores import score_marks
from bankflow.plans.account_snapshot import account_snapshot
from bankflow.plans.scorecard import scorecard_month
from bankflow.schemas import ACCOUNTS, CREDIT_SCORES, CUSTOMERS, SNAPSHOTS, TRANSACTIONS
from bankflow.session import scratch_path
from bankflow.sources import read_snapshot_day
from tests.helpers import d, dec


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def prepared(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, ddl, name, partition=None):
    path = scratch_path(spark, name)
    writer = spark.createDataFrame([], ddl).write
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(ddl).parquet(path)


def snapshots(spark):
    path = scratch_path(spark, "snapshots")
    row = ("a", "c", "LOAN", "p", d("2024-01-01"), "ACTIVE", dec("1"), None, None, dec("0"), 0)
    days = [(d(f"2025-0{m}-28"), *row) for m in range(1, 7)]
    spark.createDataFrame(days, SNAPSHOTS).write.partitionBy("snapshot_date").parquet(path)
    return path, spark.read.parquet(path)


def test_latest_rows_are_pruned_before_the_shuffle(spark):
    shots = table(spark, SNAPSHOTS, "s")
    scores = table(spark, CREDIT_SCORES, "c")
    valid, _ = clean_transactions(table(spark, TRANSACTIONS, "t"))
    for df in (latest_per_month(shots), score_marks(scores, report_months(shots)), valid):
        plan = prepared(df)
        assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_snapshot_reads_only_its_columns_and_day(spark):
    plan = prepared(
        account_snapshot(table(spark, ACCOUNTS, "a"), table(spark, TRANSACTIONS, "t"), "2025-08-01")
    )
    read = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)", plan) if "txn_id" in s)
    assert "merchant_category" not in read and "channel" not in read
    assert "EqualTo(status,COMPLETED)" in plan and "LessThan(txn_date" in plan


def test_month_load_prunes_snapshot_folders(spark):
    path, shots = snapshots(spark)
    months = report_months(shots, "2025-03-01")
    scan = re.search(r"PartitionFilters: \[([^\]]*)\]", prepared(months)).group(1)
    assert ">= 2025-02-01" in scan and "< 2025-04-01" in scan
    day = prepared(read_snapshot_day(spark, path, "2025-03-28"))
    assert "snapshot_date" in re.search(r"PartitionFilters: \[([^\]]*)\]", day).group(1)
    card = scorecard_month(
        table(spark, CUSTOMERS, "c"), shots, table(spark, ACCOUNTS, "a"),
        table(spark, TRANSACTIONS, "t"), table(spark, CREDIT_SCORES, "s"), "2025-03-01",
    )
    plan = card._jdf.queryExecution().optimizedPlan().toString()
    assert "2025-02-01" in plan
    assert [str(r[0]) for r in months.orderBy("month_start").collect()] == [
        "2025-02-01", "2025-03-01"
    ]


def test_balances_read_the_snapshots_once(spark):
    _, shots = snapshots(spark)
    both = month_balance_and_carried(shots, report_months(shots))
    assert len(re.findall(r"ReadSchema: struct<account_id", prepared(both))) == 1


def test_rolling_moves_the_rows_once_by_customer(spark):
    txns, accounts = table(spark, TRANSACTIONS, "t"), table(spark, ACCOUNTS, "a")
    plan = prepared(high_frequency(txns, accounts))
    # The hot branch has slices; the other one a single exchange under its window.
    cold = plan[plan.index("Union"):].split("_slice")[0]
    window = cold[cold.index("Window [sum"):]
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id#\d+, ", window.split("Join")[0])) == 1
