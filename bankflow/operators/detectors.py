"""The three fraud rules. Each returns typed facts; ``alerts`` turns them into alert rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.functions import decimal_ratio, money, rounded_ratio, sorted_set
from bankflow.operators.activity import completed, with_customer, with_location
from bankflow.operators.rolling import HOT_ROWS, rolling_totals


def customer_counts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Completed transactions per customer, counted per account before the accounts are joined."""
    per_account = completed(transactions).groupBy("account_id").agg(F.count("*").alias("key_rows"))
    return (
        with_customer(per_account, accounts)
        .groupBy("customer_id")
        .agg(F.sum("key_rows").alias("key_rows"))
    )


def rolling_count(
    transactions: DataFrame, accounts: DataFrame, seconds: int = 3600, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Completed transactions of the customer in the last ``seconds``, both ends included."""
    rows = with_customer(
        completed(transactions).select("account_id", "txn_date"), accounts
    ).select("customer_id", "txn_date", F.lit(0).alias("amount"))
    return rolling_totals(
        rows,
        seconds=seconds,
        counts=customer_counts(transactions, accounts),
        hot_rows=hot_rows,
    ).select("customer_id", "txn_date", F.col("window_rows").alias("txn_count"))


def collapse_triggers(triggers: DataFrame) -> DataFrame:
    """One row per customer and day of the triggering transactions."""
    return triggers.groupBy(
        "customer_id", F.to_date("txn_date").alias("alert_date")
    ).agg(
        F.max("txn_count").alias("max_transactions"),
        F.min("txn_date").alias("first_trigger_at"),
    )


def high_frequency(
    transactions: DataFrame,
    accounts: DataFrame,
    seconds: int = 3600,
    min_count: int = 5,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Customer-days with a transaction that is at least the ``min_count``-th in the time range."""
    counted = rolling_count(transactions, accounts, seconds, hot_rows)
    return collapse_triggers(counted.filter(F.col("txn_count") >= min_count))


def distinct_cities(
    transactions: DataFrame, accounts: DataFrame, locations: DataFrame
) -> DataFrame:
    """Distinct merchant cities per customer and day, as a count and a sorted list.

    Repeats are removed per account and day with map-side combine before the accounts are joined, so
    a list is built from distinct cities only and never from raw rows.
    """
    dated = completed(transactions).select(
        "txn_id", "account_id", F.to_date("txn_date").alias("alert_date")
    )
    placed = (
        with_location(dated, locations.filter(F.col("merchant_city").isNotNull()))
        .select("account_id", "alert_date", "merchant_city")
        .distinct()
    )
    return cities_of(placed, accounts)


def cities_of(placed: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct cities per customer and day from distinct cities per account and day."""
    return (
        with_customer(placed.select("account_id", "alert_date", "merchant_city"), accounts)
        .select("customer_id", "alert_date", "merchant_city")
        .distinct()
        .groupBy("customer_id", "alert_date")
        .agg(F.count("*").alias("city_count"), sorted_set("merchant_city").alias("cities"))
    )


def multi_city(
    transactions: DataFrame, accounts: DataFrame, locations: DataFrame, min_cities: int = 3
) -> DataFrame:
    """Customer-days with purchases in at least ``min_cities`` cities."""
    return distinct_cities(transactions, accounts, locations).filter(
        F.col("city_count") >= min_cities
    )


def rolling_average_before(
    transactions: DataFrame, accounts: DataFrame, days: int = 30, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each completed transaction with sum and count of the amounts' size in the days before it.

    Sum and count stand for the mean without rounding it.
    """
    rows = with_customer(
        completed(transactions).select("txn_id", "account_id", "txn_date", "amount"), accounts
    ).select("customer_id", "txn_id", "txn_date", F.abs(money("amount")).alias("amount"))
    return rolling_totals(
        rows,
        seconds=days * 86_400,
        exclude_current=True,
        counts=customer_counts(transactions, accounts),
        hot_rows=hot_rows,
    )


def first_transaction(transactions: DataFrame) -> DataFrame:
    """Time of the first completed transaction in the data."""
    return completed(transactions).agg(F.min("txn_date").alias("first_txn"))


def high_amount(
    transactions: DataFrame,
    accounts: DataFrame,
    days: int = 30,
    ratio: int | Decimal | str = 3,
    warmup_days: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Transactions above ``ratio`` times the customer's mean of the days before.

    Transactions in the first ``warmup_days`` of the data set (by default ``days``) give no alert
    but count in later means. The comparison is ``amount * n > ratio * sum``, which is exact.
    """
    rolled = rolling_average_before(transactions, accounts, days, hot_rows)
    return amount_facts(
        rolled.filter(is_high_amount(first_transaction(transactions), days, ratio, warmup_days))
    )


def is_high_amount(
    first_txn: DataFrame, days: int, ratio: int | Decimal | str, warmup_days: int | None
) -> Column:
    """The rule of :func:`high_amount` on rows with ``window_rows`` and ``window_sum``."""
    warmup = days if warmup_days is None else warmup_days
    start = first_txn.scalar() + F.expr(f"interval '{int(warmup)}' day")
    factor = F.lit(Decimal(str(ratio)))
    return (
        (F.col("window_rows") > 0)
        & (F.col("txn_date") >= start)
        & (F.col("amount") * F.col("window_rows") > factor * F.col("window_sum"))
    )


def amount_facts(high: DataFrame) -> DataFrame:
    """What the amount rule reports of its transactions."""
    return high.select(
        "customer_id",
        F.to_date("txn_date").alias("alert_date"),
        "txn_id",
        "txn_date",
        "amount",
        "window_rows",
        "window_sum",
        F.round(decimal_ratio("window_sum", "window_rows"), 2).alias("avg_amount"),
        rounded_ratio(F.col("amount") * F.col("window_rows"), "window_sum", 2).alias(
            "ratio_to_avg"
        ),
    )
