import os

import pytest

from bankflow.operators.activity import daily_activity, of_day
from bankflow.operators.quality import (
    QualityError,
    dq_report,
    enforce,
    observed_report,
    orphan_transactions,
    partition_counts,
)
from bankflow.plans.account_snapshot import (
    account_snapshot,
    build_snapshot,
    run_account_snapshot,
    stage_snapshot,
)
from bankflow.session import scratch_path
from bankflow.sinks import export_csv
from bankflow.sinks.staged import Staging
from bankflow.sinks.tables import snapshot_columns
from bankflow.sources import read_csv, read_snapshot_day, read_snapshots
from tests.helpers import dec, plan_of, rows, ts

ACCOUNTS = "account_id string, customer_id string, balance double, credit_limit double"
TXNS = (
    "txn_id string, account_id string, txn_date timestamp_ntz, amount double, status string"
)
DAY = "2025-08-01"


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame(
        [("a1", "c1", 10.1, None), ("a2", "c1", 0.0, 5.0), ("a3", "c2", 1.0, None)], ACCOUNTS
    )


@pytest.fixture
def txns(spark):
    return spark.createDataFrame(
        [
            ("t1", "a1", ts("2025-08-01T00:00:00"), 0.1, "COMPLETED"),
            ("t2", "a1", ts("2025-08-01T23:59:59.999999"), -0.3, "COMPLETED"),
            ("t3", "a1", ts("2025-08-02T00:00:00"), 9.0, "COMPLETED"),
            ("t4", "a2", ts("2025-08-01T12:00:00"), 7.0, "PENDING"),
            (None, "a3", ts("2025-08-01T12:00:00"), 2.0, "COMPLETED"),
            ("t6", "lost", ts("2025-08-01T12:00:00"), 4.0, "COMPLETED"),
        ],
        TXNS,
    )


def test_snapshot_keeps_idle_accounts_and_counts_ids(accounts, txns):
    got = rows(
        account_snapshot(accounts, txns, DAY), "account_id", "daily_net_amount", "daily_txn_count"
    )
    assert got == [("a1", dec("-0.20"), 2), ("a2", dec("0.00"), 0), ("a3", dec("2.00"), 0)]


def test_empty_day(accounts, txns):
    snapshot = account_snapshot(accounts, txns, "2024-01-01")
    assert {r["daily_txn_count"] for r in snapshot.collect()} == {0}
    day = of_day(txns, "2024-01-01")
    summary = daily_activity(day)
    report = enforce(dq_report(accounts, build_snapshot(accounts, summary, DAY), day, summary))
    assert all(r["passed"] for r in report)


def test_report_shows_orphans_without_stopping(accounts, txns):
    day = of_day(txns, DAY)
    summary = daily_activity(day)
    report = enforce(dq_report(accounts, build_snapshot(accounts, summary, DAY), day, summary))
    by_name = {r["check"]: r for r in report}
    assert not by_name["orphan_transactions"]["passed"]
    assert by_name["orphan_transactions"]["actual"] == 1
    assert by_name["amount_reconciliation"]["actual"] == dec("5.80")
    assert rows(orphan_transactions(day, accounts)) == [("lost", 1, dec("4.00"))]


@pytest.mark.parametrize("extra", [("a1", "c9", 1.0, None), (None, "c9", 1.0, None)])
def test_gate_stops_before_the_write(spark, accounts, txns, extra):
    bad = accounts.union(spark.createDataFrame([extra], ACCOUNTS))
    target, audit = scratch_path(spark, "t"), scratch_path(spark, "t")
    with pytest.raises(QualityError):
        run_account_snapshot(bad, txns, DAY, target, audit)
    run = spark.read.parquet(audit).first()
    assert (run["dq_status"], run["job_status"], run["row_count"]) == ("FAIL", "FAILED", None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(target)


def test_rerun_replaces_only_its_partition(spark, accounts, txns):
    target, audit = scratch_path(spark, "t"), scratch_path(spark, "t")
    run_account_snapshot(accounts, txns, "2025-08-02", target, audit)
    local = target.removeprefix("file:")
    other = f"{local}/snapshot_date=2025-08-02"
    before = {f: os.stat(f"{other}/{f}").st_mtime_ns for f in os.listdir(other)}
    for _ in range(2):
        run_account_snapshot(accounts, txns, DAY, target, audit, run_id="RUN_1")
    assert before == {f: os.stat(f"{other}/{f}").st_mtime_ns for f in os.listdir(other)}
    assert [r[1] for r in rows(partition_counts(read_snapshots(spark, target)))] == [3, 3]
    day = read_snapshot_day(spark, target, DAY)
    assert day.columns[-1] == "snapshot_date" and day.count() == 3
    assert dict(day.dtypes)["daily_net_amount"] == "decimal(15,2)"
    runs = spark.read.parquet(audit)
    assert runs.count() == 3 and {r["row_count"] for r in runs.collect()} == {3}


def test_every_source_is_scanned_once(spark, accounts, txns, monkeypatch):
    """All staged tables together scan accounts and transactions once, and the rest reads staged rows."""
    source = scratch_path(spark, "source")
    accounts.write.parquet(f"{source}/accounts")
    txns.write.parquet(f"{source}/transactions")
    scans, plain = [], Staging.write

    def write(self, df, name, **figures):
        scans.extend(f.split("/")[-2] for f in df.inputFiles() if source.split("/")[-1] in f)
        assert plan_of(df).count("FileScan parquet") <= 2
        return plain(self, df, name, **figures)

    monkeypatch.setattr(Staging, "write", write)
    run_account_snapshot(
        spark.read.parquet(f"{source}/accounts"), spark.read.parquet(f"{source}/transactions"), DAY,
        scratch_path(spark, "t"),
    )
    assert sorted(set(scans)) == ["accounts", "transactions"]
    files = len(spark.read.parquet(f"{source}/accounts").inputFiles())
    assert scans.count("accounts") == files


def test_observed_figures_equal_the_joined_report(spark, accounts, txns):
    more = txns.unionByName(spark.createDataFrame([("t7", None, ts("2025-08-01T01:00:00"), 1.0, "COMPLETED")], TXNS))
    staging = Staging(spark)
    stage_snapshot(staging, accounts, more, DAY)
    day = of_day(more, DAY)
    summary = daily_activity(day)
    joined = dq_report(accounts, build_snapshot(accounts, summary, DAY), day, summary)
    assert rows(observed_report(spark, staging.figures)) == rows(joined)
    assert staging.figures["orphans"] == 2
    paths = list(staging.paths)
    staging.drop()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_staged_tables_go_after_a_success(spark, accounts, txns):
    target = scratch_path(spark, "t")
    shared = os.path.dirname(target).removeprefix("file:")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    run_account_snapshot(accounts, txns, DAY, target)
    assert set(os.listdir(shared)) - before == {os.path.basename(target)}
    nothing = spark.createDataFrame([], ACCOUNTS)
    report = run_account_snapshot(nothing, txns.limit(0), DAY, scratch_path(spark, "t"))
    assert all(r["passed"] for r in report)


def test_export_is_one_file_with_header(spark, accounts, txns):
    path = scratch_path(spark, "t")
    snapshot = account_snapshot(accounts, txns, DAY)
    with pytest.raises(ValueError, match="account_type"):
        export_csv(snapshot, path)
    export_csv(snapshot, path, snapshot_columns(snapshot).columns)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".csv")]
    assert len(files) == 1
    back = read_csv(spark, path)
    assert back.columns[:3] == ["snapshot_date", "account_id", "customer_id"]
    assert back.count() == 3 and dict(back.dtypes)["snapshot_date"] == "date"
