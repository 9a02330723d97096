"""Deterministic merchant cities for transactions that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankflow.functions import hash_number, not_blank

# Fixed value: the source label of generated locations.
SOURCE = "SYNTHETIC_TEST"


def city_list(customers: DataFrame) -> DataFrame:
    """Distinct cities with their position (from 0) in ascending order.

    The position is the number of cities under earlier first letters plus the rank under the same
    letter, so no task sorts the whole list.
    """
    cities = customers.filter(not_blank("city")).select("city").distinct()
    lettered = cities.withColumn("_letter", F.substring("city", 1, 1))
    before = Window.orderBy("_letter").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lettered.groupBy("_letter")
        .agg(F.count("*").alias("_n"))
        .select("_letter", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_letter").orderBy("city")
    return lettered.join(offsets, "_letter").select(
        "city", (F.col("_offset") + F.row_number().over(inside) - 1).alias("city_index")
    )


def home_city(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """City of each account's customer; accounts without one drop out."""
    return accounts.select("account_id", "customer_id").join(
        customers.filter(not_blank("city")).select("customer_id", "city"), "customer_id"
    ).select("account_id", F.col("city").alias("home_city"))


def assign_city(
    transactions: DataFrame, accounts: DataFrame, customers: DataFrame, home_share: int = 95
) -> DataFrame:
    """A city per purchase: home for ``home_share`` percent of the ids, else one of the others.

    The choice depends on the MD5 of the transaction id and on nothing else, so reruns agree. The
    n-th of the other cities has position n in the full list, or n+1 from the home city on; so the
    list is never copied into rows or tasks, only looked up by position. With a single city every
    purchase is at home.
    """
    cities = city_list(customers)
    total = customers.filter(not_blank("city")).agg(F.count_distinct("city")).scalar()
    homes = home_city(accounts, customers).join(
        cities.select(F.col("city").alias("home_city"), F.col("city_index").alias("_home")),
        "home_city",
    )
    number = F.col("_number")
    other = F.pmod(F.floor(number / 100), F.greatest(F.col("_cities") - 1, F.lit(1)))
    stays = (F.pmod(number, F.lit(100)) < home_share) | (F.col("_cities") < 2)
    return (
        transactions.filter(not_blank("merchant_category"))
        .select("txn_id", "account_id", hash_number("txn_id").alias("_number"))
        .join(homes.select("account_id", "_home"), "account_id")
        .withColumn("_cities", total)
        .withColumn("_other", other)
        .withColumn(
            "city_index",
            F.when(stays, F.col("_home")).otherwise(
                F.col("_other") + F.when(F.col("_other") >= F.col("_home"), 1).otherwise(0)
            ),
        )
        .join(cities.withColumnRenamed("city", "merchant_city"), "city_index")
        .select("txn_id", "merchant_city", F.lit(SOURCE).alias("location_source"))
    )
