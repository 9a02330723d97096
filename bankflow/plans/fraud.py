"""All fraud alerts in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.functions import money
from bankflow.operators.activity import completed, with_customer
from bankflow.operators.alerts import (
    amount_alerts,
    city_alerts,
    frequency_alerts,
    union_alerts,
)
from bankflow.operators.detectors import (
    amount_facts,
    cities_of,
    collapse_triggers,
    high_amount,
    high_frequency,
    is_high_amount,
    multi_city,
)
from bankflow.operators.rolling import HOT_ROWS, Lane, rolling_lanes
from bankflow.sinks.staged import Staging


def daily_places(transactions: DataFrame, locations: DataFrame) -> DataFrame:
    """Completed transactions per account, day and merchant city: their number and the first time.

    Transactions without a place count under a NULL city.
    """
    dated = completed(transactions).select(
        "txn_id", "account_id", "txn_date", F.to_date("txn_date").alias("alert_date")
    )
    return (
        dated.join(locations.select("txn_id", "merchant_city"), "txn_id", "left")
        .groupBy("account_id", "alert_date", "merchant_city")
        .agg(F.count("*").alias("txns"), F.min("txn_date").alias("first_txn"))
    )


def fraud_hits(
    transactions: DataFrame,
    accounts: DataFrame,
    *,
    counts: DataFrame | None,
    first_txn: DataFrame,
    seconds: int,
    min_count: int,
    days: int,
    ratio: int,
    warmup_days: int | None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Transactions that the frequency or the amount rule marks, from one sweep over the time line."""
    rows = with_customer(
        completed(transactions).select("txn_id", "account_id", "txn_date", "amount"), accounts
    ).select("customer_id", "txn_id", "txn_date", F.abs(money("amount")).alias("amount"))
    lanes = [Lane("rate", seconds, total=False), Lane("window", days * 86_400, exclude_current=True)]
    swept = rolling_lanes(rows, lanes, counts=counts, hot_rows=hot_rows)
    return (
        swept.withColumn("frequent", F.col("rate_rows") >= min_count)
        .withColumn("high", F.coalesce(is_high_amount(first_txn, days, ratio, warmup_days), F.lit(False)))
        .filter("frequent or high")
    )


def fraud_alerts(
    transactions: DataFrame,
    accounts: DataFrame,
    locations: DataFrame,
    *,
    seconds: int = 3600,
    min_count: int = 5,
    min_cities: int = 3,
    days: int = 30,
    ratio: int = 3,
    warmup_days: int | None = None,
    hot_rows: int = HOT_ROWS,
    staging: Staging | None = None,
) -> DataFrame:
    """Union of the three rules; order it with ``order_alerts`` for a report.

    Transactions are read twice: once reduced to places, which give the city rule, the rows per customer
    and the first transaction, and once for a sweep that serves both rolling rules. The places and the
    marked transactions are staged; ``staging`` lets the caller remove them after use.
    """
    staging = staging or Staging(transactions.sparkSession)
    places = staging.write(daily_places(transactions, locations), "places")
    per_account = places.groupBy("account_id").agg(F.sum("txns").alias("key_rows"))
    counts = with_customer(per_account, accounts).groupBy("customer_id").agg(
        F.sum("key_rows").alias("key_rows")
    )
    hits = staging.write(
        fraud_hits(
            transactions, accounts, counts=counts, first_txn=places.agg(F.min("first_txn")),
            seconds=seconds, min_count=min_count, days=days, ratio=ratio, warmup_days=warmup_days,
            hot_rows=hot_rows,
        ),
        "hits",
    )
    frequent = hits.filter("frequent").withColumnRenamed("rate_rows", "txn_count")
    cities = cities_of(places.filter(F.col("merchant_city").isNotNull()), accounts)
    return union_alerts(
        frequency_alerts(collapse_triggers(frequent)),
        city_alerts(cities.filter(F.col("city_count") >= min_cities)),
        amount_alerts(amount_facts(hits.filter("high"))),
    )


def fraud_alerts_by_rule(
    transactions: DataFrame,
    accounts: DataFrame,
    locations: DataFrame,
    *,
    seconds: int = 3600,
    min_count: int = 5,
    min_cities: int = 3,
    days: int = 30,
    ratio: int = 3,
    warmup_days: int | None = None,
) -> DataFrame:
    """The rules one by one, each with passes of its own, as the check of :func:`fraud_alerts`."""
    return union_alerts(
        frequency_alerts(high_frequency(transactions, accounts, seconds, min_count)),
        city_alerts(multi_city(transactions, accounts, locations, min_cities)),
        amount_alerts(high_amount(transactions, accounts, days, ratio, warmup_days)),
    )
