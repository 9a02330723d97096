"""Alert rows: customer, type, date and details as JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.functions import iso_text
from bankflow.operators.ranking import with_row_number

# Alert types and the keys of their details.
HIGH_FREQUENCY = "HIGH_FREQUENCY_1H"
MULTI_CITY = "MULTI_CITY_1D"
HIGH_AMOUNT = "HIGH_AMOUNT_30D"


def frequency_alerts(facts: DataFrame) -> DataFrame:
    return _alerts(
        facts,
        HIGH_FREQUENCY,
        F.col("max_transactions").alias("max_transactions_in_1h"),
        iso_text("first_trigger_at").alias("first_trigger_at"),
    )


def city_alerts(facts: DataFrame) -> DataFrame:
    return _alerts(facts, MULTI_CITY, F.col("city_count"), F.col("cities"))


def amount_alerts(facts: DataFrame) -> DataFrame:
    return _alerts(
        facts,
        HIGH_AMOUNT,
        F.col("txn_id"),
        iso_text("txn_date").alias("txn_date"),
        F.col("amount"),
        F.col("avg_amount").alias("avg_amount_30d"),
        F.col("ratio_to_avg"),
    )


def _alerts(facts: DataFrame, alert_type: str, *details: Column) -> DataFrame:
    return facts.select(
        "customer_id",
        F.lit(alert_type).alias("alert_type"),
        "alert_date",
        F.to_json(F.struct(*details), {"ignoreNullFields": "false"}).alias("details_json"),
    )


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """All alerts, repeats kept."""
    return reduce(DataFrame.unionByName, alerts)


def report_order() -> list[Column]:
    """Date, customer, type."""
    return [F.asc_nulls_last(c) for c in ("alert_date", "customer_id", "alert_type")]


def order_alerts(alerts: DataFrame) -> DataFrame:
    """The alerts in report order."""
    return alerts.orderBy(*report_order())


def rank_alerts(alerts: DataFrame, *ties: Column) -> DataFrame:
    """Adds ``row_number``, the place in the report; ``ties`` order alerts of one date, customer and type."""
    return with_row_number(alerts, [*report_order(), *[t.asc_nulls_last() for t in ties], F.asc("details_json")])


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per type, and the total under type NULL as in a SQL rollup."""
    return alerts.rollup("alert_type").agg(F.count("*").alias("alerts"))
