"""Report months and the customer-by-month grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.functions import month_of, month_range, sorted_set

# Key of the customer-months, in the order that joins and groupings sort it by.
GRAIN = ["customer_id", "month_start"]


def report_months(snapshots: DataFrame, run_month: str | None = None) -> DataFrame:
    """Distinct months that have snapshots; with a run month only that month and the one before.

    The month range is a plain comparison on ``snapshot_date``, so on a table partitioned by that
    column it prunes folders.
    """
    if run_month is not None:
        snapshots = snapshots.filter(month_range("snapshot_date", run_month))
    return snapshots.select(month_of("snapshot_date").alias("month_start")).distinct()


def month_list(months: DataFrame) -> Column:
    """The report months as one ascending array, as an uncorrelated scalar subquery.

    A date column has at most twelve months a year, so the array is small whatever the data size;
    it takes the place of a cross join or a join on a range of dates.
    """
    return months.agg(sorted_set("month_start").alias("months")).scalar()


def customer_months(customers: DataFrame, months: DataFrame) -> DataFrame:
    """Every customer in every report month, also those without accounts."""
    # The outer form keeps Spark from copying the month subquery into a filter on the customers.
    return (
        customers.select("customer_id", month_list(months).alias("months"))
        .select(F.explode_outer("months").alias("month_start"), "customer_id")
        .filter(F.col("month_start").isNotNull())
    )


def assemble_month(scaffold: DataFrame, *measures: DataFrame) -> DataFrame:
    """The scaffold left-joined with each measure on customer and month.

    Every measure has at most one row per key, so rows do not multiply. All joins share their keys:
    the narrow scaffold moves once, and a measure that was grouped by these keys last does not move
    again. The month in the key spreads the rows of any one customer. The customer comes first in the key:
    a sort compares eight bytes of it at once, and few rows tie there, while nearly all tie on the month.
    """
    columns = scaffold.columns
    for measure in measures:
        columns = columns + [c for c in measure.columns if c not in GRAIN]
        scaffold = scaffold.join(measure, GRAIN, "left")
    return scaffold.select(*columns)


def customer_coverage(customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """How many customers have an account and how many have none."""
    holders = accounts.select("customer_id").distinct().withColumn("_has", F.lit(True))
    return customers.select("customer_id").join(holders, "customer_id", "left").agg(
        F.count("*").alias("customers"),
        F.count("_has").alias("with_account"),
        F.count_if(F.col("_has").isNull()).alias("without_account"),
    )
