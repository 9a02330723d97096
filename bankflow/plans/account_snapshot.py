"""Daily account snapshot: build, check, publish, audit."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.functions import money, parse_day
from bankflow.operators.activity import daily_activity, of_day, with_activity
from bankflow.operators.quality import (
    QualityError,
    account_summary,
    enforce,
    observed_report,
    summary_figures,
)
from bankflow.schemas import SNAPSHOTS, column_names
from bankflow.sinks import record_lineage, record_run, write_snapshot
from bankflow.sinks.audit import lineage_edges
from bankflow.sinks.staged import Staging
from bankflow.sinks.tables import snapshot_columns


def account_snapshot(accounts: DataFrame, transactions: DataFrame, day: str) -> DataFrame:
    """All accounts with the net amount and count of their completed transactions of ``day``."""
    return build_snapshot(accounts, daily_activity(of_day(transactions, day)), day)


def build_snapshot(accounts: DataFrame, summary: DataFrame, day: str) -> DataFrame:
    typed = accounts.withColumn("balance", money("balance")).withColumn(
        "credit_limit", money("credit_limit")
    )
    return with_activity(typed, summary).withColumn("snapshot_date", F.lit(parse_day(day)))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows, for a look at the result."""
    return df.limit(n)


def stage_snapshot(staging: Staging, accounts: DataFrame, transactions: DataFrame, day: str) -> DataFrame:
    """The snapshot of ``day`` as a staged table, with all figures of the quality gate observed.

    Each source is scanned once: accounts and the day's transactions are staged as they are read, one
    aggregation over both gives every account's activity and the orphans, and the snapshot is staged
    before anything is published.
    """
    rows = F.count(F.lit(1))
    kept = staging.write(accounts, "accounts", account_rows=rows)
    txns = staging.write(
        of_day(transactions, day).select("account_id", "txn_id", "amount"),
        "transactions",
        transaction_total=F.sum(money("amount")),
    )
    summary = staging.write(account_summary(kept, txns), "summary", **summary_figures())
    active = summary.filter("account_rows > 0 and txn_rows > 0")
    return staging.write(
        build_snapshot(kept, active.select("account_id", "daily_net_amount", "daily_txn_count"), day),
        "snapshot",
        snapshot_rows=rows,
        null_accounts=F.count_if(F.col("account_id").isNull()),
    )


def run_account_snapshot(
    accounts: DataFrame,
    transactions: DataFrame,
    day: str,
    output_path: str,
    audit_path: str | None = None,
    run_id: str | None = None,
    lineage_path: str | None = None,
) -> list:
    """Build the snapshot of ``day``, check it, then replace its partition.

    The checks compare figures that were observed while the published rows were staged. A failed check
    writes nothing but the audit row. With ``lineage_path`` the run's column lineage is appended after the
    partition. Staged tables are removed after a success and kept otherwise, to look into.
    Returns the rows of the quality report.
    """
    spark = accounts.sparkSession
    parse_day(day)
    run = {
        "run_id": run_id or f"RUN_{uuid.uuid4().hex}",
        "pipeline_name": "account_snapshot",
        "snapshot_date": parse_day(day),
        "source": "accounts + transactions",
        "target": output_path,
        "start_time": datetime.now(timezone.utc),
    }
    status = {"dq_status": None, "job_status": "FAILED"}
    staging = Staging(spark)
    try:
        snapshot = stage_snapshot(staging, accounts, transactions, day)
        report = enforce(observed_report(spark, staging.figures))
        status["dq_status"] = "PASS"
        write_snapshot(
            snapshot_columns(snapshot.withColumn("daily_net_amount", money("daily_net_amount"))),
            output_path,
        )
        if lineage_path:
            record_lineage(spark, lineage_path, snapshot_edges(accounts.columns, run["run_id"]))
        rows = next(int(r["actual"]) for r in report if r["check"] == "row_count")
        status |= {"job_status": "SUCCESS", "row_count": rows}
        staging.drop()
        return report
    except QualityError:
        status["dq_status"] = "FAIL"
        raise
    finally:
        if audit_path:
            record_run(
                spark, audit_path, run | status | {"end_time": datetime.now(timezone.utc)}
            )


def snapshot_edges(account_columns: list[str], run_id: str) -> list[dict]:
    """What each snapshot column is made from: itself, or the day's transactions."""
    made = {
        "daily_net_amount": ("amount", "account_id", "txn_date", "status"),
        "daily_txn_count": ("txn_id", "account_id", "txn_date", "status"),
    }
    copied = {c: ("accounts", (c,)) for c in column_names(SNAPSHOTS) if c in account_columns}
    return lineage_edges(
        "account_snapshot", run_id, "account_snapshots",
        copied | {c: ("transactions", sources) for c, sources in made.items()},
    )
