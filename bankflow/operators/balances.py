"""Month-end balances from daily account snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankflow.functions import month_of
from bankflow.operators.scaffold import GRAIN, month_list

CARD = "CREDIT_CARD"
BALANCES = ["total_balance", "credit_card_balance", "total_credit_limit"]


def latest_per_month(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each account in each month.

    Filtering ``row_number`` to 1 lets Spark keep one row per key in every map task before the
    shuffle, so an account with very many rows costs no more than one row per task. Equal dates are
    settled by customer, balance and limit, to keep reruns the same.
    """
    newest = Window.partitionBy("account_id", "month_start").orderBy(
        F.desc_nulls_last("snapshot_date"),
        F.desc_nulls_last("customer_id"),
        F.desc_nulls_last("balance"),
        F.desc_nulls_last("credit_limit"),
    )
    return (
        snapshots.select(
            month_of("snapshot_date").alias("month_start"),
            "snapshot_date", "account_id", "customer_id", "account_type", "balance",
            "credit_limit",
        )
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .drop("rn")
    )


def card_totals() -> list[Column]:
    """Aggregates of the card balance and card limit in a group of accounts."""
    is_card = F.col("account_type") == CARD
    return [
        F.sum(F.when(is_card, F.col("balance")).otherwise(0)).alias("credit_card_balance"),
        F.sum(F.when(is_card, F.coalesce("credit_limit", F.lit(0))).otherwise(0)).alias(
            "total_credit_limit"
        ),
    ]


def month_balance(snapshots: DataFrame) -> DataFrame:
    """Total balance, card balance and card limit per customer and month."""
    return (
        latest_per_month(snapshots)
        .groupBy(*GRAIN)
        .agg(F.sum("balance").alias("total_balance"), *card_totals())
        .select("month_start", "customer_id", *BALANCES)
    )


def with_previous(monthly: DataFrame, column: str = "total_balance") -> DataFrame:
    """Value of the customer's previous month in the data, NULL for the first.

    A window group is one customer's months, so its size is bounded by the report months.
    """
    by_month = Window.partitionBy("customer_id").orderBy("month_start")
    return monthly.withColumn("previous_month_balance", F.lag(column).over(by_month))


def month_balance_and_carried(snapshots: DataFrame, months: DataFrame) -> DataFrame:
    """:func:`month_balance` plus the total balance of the report month before.

    Each month-end snapshot counts once for its own month and once, as ``carried_balance``, for the
    report month after it; one grouping sums both. Joined to the scaffold this gives the value of
    :func:`with_previous` without a second pass over the snapshots and without gathering a
    customer's months. The last report month carries nowhere.
    """
    own = F.col("_ahead") == 0
    following = F.get(F.filter("_months", lambda m: m > F.col("_snapshot_month")), 0)
    spread = (
        latest_per_month(snapshots)
        .withColumnRenamed("month_start", "_snapshot_month")
        .withColumn("_months", month_list(months))
        .withColumn("_following", following)
        .drop("_months")
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_ahead"))
        .withColumn(
            "month_start", F.when(own, F.col("_snapshot_month")).otherwise(F.col("_following"))
        )
        .filter(F.col("month_start").isNotNull())
        .select(
            "month_start",
            "customer_id",
            F.when(own, F.col("account_type")).alias("account_type"),
            F.when(own, F.col("balance")).alias("balance"),
            F.when(own, F.col("credit_limit")).alias("credit_limit"),
            F.when(~own, F.col("balance")).alias("_carried"),
        )
    )
    summed = spread.groupBy(*GRAIN).agg(
        F.sum("balance").alias("total_balance"),
        *card_totals(),
        F.sum("_carried").alias("carried_balance"),
    )
    return summed.select("month_start", "customer_id", *BALANCES, "carried_balance")
