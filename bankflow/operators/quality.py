"""Data-quality gate of the daily snapshot."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.functions import money

_TOTAL = "decimal(38,2)"


class QualityError(ValueError):
    """A required check failed; nothing may be written."""


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def snapshot_metrics(snapshot: DataFrame) -> DataFrame:
    """Rows, distinct account ids and NULL account ids in one pass."""
    return snapshot.agg(
        F.count("*").alias("snapshot_rows"),
        F.count_distinct("account_id").alias("distinct_accounts"),
        F.count_if(F.col("account_id").isNull()).alias("null_accounts"),
    )


def reconcile(transactions: DataFrame, summary: DataFrame) -> DataFrame:
    """Amount total before and after the aggregation, zero when there is nothing."""
    before = transactions.agg(F.sum(money("amount")).alias("t"))
    after = summary.agg(F.sum("daily_net_amount").alias("t"))
    return before.select(
        F.coalesce("t", F.lit(0)).cast(_TOTAL).alias("transaction_total"),
        F.coalesce(after.scalar(), F.lit(0)).cast(_TOTAL).alias("summary_total"),
    )


def orphan_transactions(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows and amount per account id that no account has, including a NULL id."""
    per_account = transactions.groupBy("account_id").agg(
        F.count("*").alias("orphan_rows"), F.sum(money("amount")).alias("orphan_amount")
    )
    return per_account.join(accounts.select("account_id"), "account_id", "left_anti")


def partition_counts(snapshots: DataFrame) -> DataFrame:
    """Rows per snapshot date."""
    return snapshots.groupBy("snapshot_date").agg(F.count("*").alias("row_count"))


def dq_report(
    accounts: DataFrame, snapshot: DataFrame, transactions: DataFrame, summary: DataFrame
) -> DataFrame:
    """One row per check: expected and actual value, whether it passed, whether it is required.

    Orphan transactions pass the amount check (both sides are taken before the join to the
    accounts), so they have a check of their own; it warns and does not stop the job.
    """
    checked = (
        snapshot_metrics(snapshot)
        .withColumn("account_rows", row_count(accounts).scalar())
        .withColumn(
            "totals",
            reconcile(transactions, summary)
            .select(F.struct("transaction_total", "summary_total"))
            .scalar(),
        )
        .withColumn(
            "orphans",
            orphan_transactions(transactions, accounts)
            .agg(F.coalesce(F.sum("orphan_rows"), F.lit(0)))
            .scalar(),
        )
    )
    checks = [
        ("row_count", "account_rows", "snapshot_rows", True),
        ("null_account_id", None, "null_accounts", True),
        ("unique_account_id", "snapshot_rows", "distinct_accounts", True),
        ("amount_reconciliation", "totals.transaction_total", "totals.summary_total", True),
        ("orphan_transactions", None, "orphans", False),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            (F.col(expected) if expected else F.lit(0)).cast(_TOTAL).alias("expected"),
            F.col(actual).cast(_TOTAL).alias("actual"),
            F.lit(required).alias("required"),
        )
        for name, expected, actual, required in checks
    ]
    return (
        checked.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .withColumn("passed", F.col("expected") == F.col("actual"))
    )


# Check, figure expected, figure found (None: zero), whether a failure stops the job.
OBSERVED_CHECKS = (
    ("row_count", "account_rows", "snapshot_rows", True),
    ("null_account_id", None, "null_accounts", True),
    ("unique_account_id", "snapshot_rows", "distinct_accounts", True),
    ("amount_reconciliation", "transaction_total", "summary_total", True),
    ("orphan_transactions", None, "orphans", False),
)


def account_summary(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per account id: its rows in ``accounts``, and rows, ids and amount of its transactions.

    Both sides are reduced by one aggregation, so the summary tells accounts without transactions,
    transactions without an account and ids that occur twice apart, without a join.
    """
    known = accounts.select(
        "account_id",
        F.lit(1).alias("_account"),
        F.lit(0).alias("_row"),
        F.lit(None).cast("string").alias("_txn"),
        F.lit(None).cast("decimal(15,2)").alias("_amount"),
    )
    moved = transactions.select(
        "account_id",
        F.lit(0).alias("_account"),
        F.lit(1).alias("_row"),
        F.col("txn_id").cast("string").alias("_txn"),
        money("amount").alias("_amount"),
    )
    return known.unionByName(moved).groupBy("account_id").agg(
        F.sum("_account").alias("account_rows"),
        F.sum("_row").alias("txn_rows"),
        F.count("_txn").alias("daily_txn_count"),
        F.sum("_amount").alias("daily_net_amount"),
    )


def summary_figures() -> dict[str, Column]:
    """Aggregates over :func:`account_summary`; a NULL id is never an account's."""
    known = F.col("account_id").isNotNull() & (F.col("account_rows") > 0)
    return {
        "distinct_accounts": F.count_if(known),
        "orphans": F.sum(F.when(known, 0).otherwise(F.col("txn_rows"))),
        "summary_total": F.sum("daily_net_amount"),
    }


def observed_report(spark: SparkSession, figures: dict) -> DataFrame:
    """The report of :func:`dq_report` from figures that were observed while tables were written."""

    def value(name: str | None) -> Decimal:
        return Decimal(0 if name is None else figures[name] or 0).quantize(Decimal("0.01"))

    rows = []
    for check, expected, actual, required in OBSERVED_CHECKS:
        want, got = value(expected), value(actual)
        rows.append((check, want, got, required, want == got))
    return spark.createDataFrame(
        rows, f"check string, expected {_TOTAL}, actual {_TOTAL}, required boolean, passed boolean"
    )


def enforce(report: DataFrame) -> list:
    """Raise :class:`QualityError` when a required check failed; return the report's few rows."""
    rows = report.collect()
    failed = [r for r in rows if r["required"] and not r["passed"]]
    if failed:
        text = "; ".join(f"{r['check']}: expected {r['expected']}, got {r['actual']}" for r in failed)
        raise QualityError(text)
    return rows
