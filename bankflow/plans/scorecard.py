"""Monthly customer health scorecard, for all months or for one run month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.functions import (
    change_ratio,
    delta,
    month_range,
    next_month,
    null_to_zero,
    parse_month,
    risk_flag,
    utilisation,
    wide_money,
)
from bankflow.functions.dates import shift_month
from bankflow.operators.activity import (
    CHANNEL_MEANS,
    TYPE_COUNTS,
    channel_mean_columns,
    monthly_activity,
)
from bankflow.operators.balances import month_balance_and_carried
from bankflow.operators.ranking import with_row_number
from bankflow.operators.scaffold import (
    assemble_month,
    customer_months,
    month_list,
    report_months,
)
from bankflow.operators.scores import asof_latest
from bankflow.sinks.staged import Staging


def monthly_facts(
    customers: DataFrame,
    months: DataFrame,
    snapshots: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    scores: DataFrame,
    ratio_scale: int,
    guard: str = "positive",
) -> DataFrame:
    """One row per customer and report month with balances, their change, activity and the as-of score.

    Every input is reduced to customer-months first and then joined to the scaffold on both keys.
    A snapshot counts for its month and, carried, for the next one; on the scaffold a month without
    accounts counts as zero, and only the first report month has no previous one.
    """
    used = utilisation(
        wide_money("credit_card_balance"), wide_money("total_credit_limit"), guard
    )
    balance = month_balance_and_carried(snapshots, months).select(
        "month_start",
        "customer_id",
        wide_money("total_balance").alias("total_balance"),
        wide_money("carried_balance").alias("carried_balance"),
        used.alias("_used"),
    )
    first = F.get(month_list(months), 0)
    later = F.col("month_start") > first
    # Ratios of one input are taken before the joins, where there are fewer rows than on the grid.
    balance = balance.select(
        "month_start",
        "customer_id",
        null_to_zero("total_balance").alias("total_balance"),
        F.when(later, null_to_zero("carried_balance")).alias("previous_month_balance"),
        null_to_zero("_used").alias("_used"),
    )
    change = change_ratio("total_balance", "previous_month_balance")
    balance = balance.select(
        "month_start",
        "customer_id",
        "total_balance",
        "previous_month_balance",
        wide_money(delta("total_balance", "previous_month_balance")).alias("mom_balance_change"),
        F.round(change, ratio_scale).cast("decimal(18,6)").alias("mom_balance_change_pct"),
        F.round("_used", ratio_scale).cast("decimal(18,6)").alias("credit_utilization"),
        # The flag compares the unrounded ratios; the score's part is added behind the joins.
        risk_flag("_used", F.lit(None).cast("decimal(5,4)"), change).alias("_balance_risk"),
    )
    facts = assemble_month(
        customer_months(customers, months),
        balance,
        monthly_activity(transactions, accounts).select(
            "month_start", "customer_id", *TYPE_COUNTS, *channel_mean_columns(scale=2)
        ),
        asof_latest(scores, months).drop("score_date"),
    )
    score_risk = risk_flag(F.lit(0), "probability_of_default", F.lit(None).cast("decimal(5,4)"))
    return facts.select(
        "month_start",
        "customer_id",
        null_to_zero("total_balance").alias("total_balance"),
        F.when(later, null_to_zero("previous_month_balance")).alias("previous_month_balance"),
        F.when(later, null_to_zero("mom_balance_change")).alias("mom_balance_change"),
        "mom_balance_change_pct",
        null_to_zero("credit_utilization").alias("credit_utilization"),
        "probability_of_default",
        *[null_to_zero(c).alias(c) for c in TYPE_COUNTS],
        *CHANNEL_MEANS,
        (F.coalesce("_balance_risk", F.lit(False)) | score_risk).alias("risk_flag"),
    )


def scorecard(
    customers: DataFrame,
    snapshots: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    scores: DataFrame,
) -> DataFrame:
    """Scorecard over all report months; the previous month is the one before in the data."""
    return monthly_facts(
        customers, report_months(snapshots), snapshots, accounts, transactions, scores, ratio_scale=4
    )


def scorecard_month(
    customers: DataFrame,
    snapshots: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    scores: DataFrame,
    run_month: str,
) -> DataFrame:
    """Scorecard rows of one month: its transactions, and snapshots of it and of the month before.

    A missing month before gives a NULL previous balance. Rows have the types of the gold table.
    """
    run = parse_month(run_month)
    return monthly_facts(
        customers,
        report_months(snapshots, run_month),
        snapshots.filter(month_range("snapshot_date", run_month)),
        accounts,
        transactions.filter(month_range("txn_date", run_month, back=0)),
        scores.filter(F.col("score_date") < F.lit(shift_month(run, 1))),
        ratio_scale=6,
        guard="nonzero",
    ).filter(F.col("month_start") == F.lit(run))


def report_order() -> list[Column]:
    return [F.asc_nulls_last("month_start"), F.asc_nulls_last("customer_id")]


def order_scorecard(rows: DataFrame) -> DataFrame:
    """Report order: month, then customer. A range sort of the whole result; use it for reports."""
    return rows.orderBy(*report_order())


def rank_scorecard(rows: DataFrame) -> DataFrame:
    """Adds ``row_number``, the place in the report.

    The rows are stored first, as numbering reads them twice.
    """
    return with_row_number(Staging(rows.sparkSession).write(rows, "report"), report_order())


def scorecard_summary(rows: DataFrame) -> DataFrame:
    """Customers and flagged customers per month."""
    return rows.groupBy("month_start").agg(
        F.count("*").alias("customers"), F.count_if("risk_flag").alias("risk_customers")
    )
