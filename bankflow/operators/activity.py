"""Transaction activity per account and per customer-month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.functions import decimal_ratio, in_day, money, month_of
from bankflow.operators.scaffold import GRAIN
from bankflow.schemas import CHANNELS, TXN_TYPES

TYPE_COUNTS = [f"{t.lower()}_count" for t in TXN_TYPES]
CHANNEL_MEANS = [f"avg_{c.lower()}_amount" for c in CHANNELS]
_SUMS = [f"sum_{c.lower()}" for c in CHANNELS]
_ROWS = [f"rows_{c.lower()}" for c in CHANNELS]


def completed(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("status") == "COMPLETED")


def of_day(transactions: DataFrame, day: str) -> DataFrame:
    """Completed transactions of one day."""
    return completed(transactions.filter(in_day("txn_date", day)))


def daily_activity(transactions: DataFrame) -> DataFrame:
    """Net amount and number of transaction ids per account; amounts keep their sign."""
    return transactions.groupBy("account_id").agg(
        F.sum(money("amount")).alias("daily_net_amount"),
        F.count("txn_id").alias("daily_txn_count"),
    )


def with_activity(accounts: DataFrame, daily: DataFrame) -> DataFrame:
    """Every account with its activity; idle accounts get zeros."""
    return accounts.join(daily, "account_id", "left").fillna(
        {"daily_net_amount": 0, "daily_txn_count": 0}
    )


def with_customer(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transactions of known accounts with the account's current customer.

    No broadcast hint: AQE broadcasts the two-column account side when its measured size allows,
    and otherwise splits the shuffle partitions of hot accounts.
    """
    return transactions.join(accounts.select("account_id", "customer_id"), "account_id")


def with_location(transactions: DataFrame, locations: DataFrame) -> DataFrame:
    """Transactions that have a merchant city."""
    return transactions.join(locations.select("txn_id", "merchant_city"), "txn_id")


def type_count_columns(style: str = "case") -> list[Column]:
    """One count per transaction type, as a conditional sum or as a filtered count."""
    if style not in ("case", "filter"):
        raise ValueError(f"unknown style {style!r}")
    columns = []
    for txn_type, name in zip(TXN_TYPES, TYPE_COUNTS):
        hit = F.col("txn_type") == txn_type
        count = F.sum(F.when(hit, 1).otherwise(0)) if style == "case" else F.count_if(hit)
        columns.append(count.alias(name))
    return columns


def channel_sum_columns() -> list[Column]:
    """Sum and row count of the amount's size per channel, the mergeable parts of a mean."""
    columns = []
    for channel, total, rows in zip(CHANNELS, _SUMS, _ROWS):
        size = F.when(F.col("channel") == channel, F.abs(money("amount")))
        columns += [F.sum(size).alias(total), F.count(size).alias(rows)]
    return columns


def monthly_activity(
    transactions: DataFrame, accounts: DataFrame, style: str = "case"
) -> DataFrame:
    """Type counts and channel sums of completed transactions per customer and month.

    The raw rows are first reduced to one row per account and month, with map-side combine, so a
    hot account is small before anything joins or moves; only those sums meet the accounts.
    """
    per_account = (
        completed(transactions)
        .groupBy("account_id", month_of("txn_date").alias("month_start"))
        .agg(*type_count_columns(style), *channel_sum_columns())
    )
    parts = TYPE_COUNTS + _SUMS + _ROWS
    return (
        with_customer(per_account, accounts)
        .groupBy(*GRAIN)
        .agg(*[F.sum(c).alias(c) for c in parts])
        .select("month_start", "customer_id", *parts)
    )


def txn_type_counts(
    transactions: DataFrame, accounts: DataFrame, style: str = "case"
) -> DataFrame:
    return monthly_activity(transactions, accounts, style).select(
        "month_start", "customer_id", *TYPE_COUNTS
    )


def channel_avg(
    transactions: DataFrame, accounts: DataFrame, scale: int | None = None
) -> DataFrame:
    """Mean size of the amount per channel, NULL where the channel was not used.

    Without ``scale`` the means keep 15 fractional digits; with it they are rounded half away from
    zero.
    """
    return monthly_activity(transactions, accounts).select(
        "month_start", "customer_id", *channel_mean_columns(scale)
    )


def channel_mean_columns(scale: int | None = 2) -> list[Column]:
    """Means from the columns :func:`monthly_activity` produced."""
    means = []
    for total, rows, name in zip(_SUMS, _ROWS, CHANNEL_MEANS):
        mean = decimal_ratio(total, rows)
        if scale is not None:
            mean = F.round(mean, scale).cast(f"decimal(20,{scale})")
        means.append(mean.alias(name))
    return means
