"""JDBC sources. Credentials are arguments and never part of the code."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.functions import in_day, parse_day
from bankflow.schemas import TRANSACTIONS, column_names


@dataclass(frozen=True)
class JdbcPartition:
    """How a table is split into parallel range reads."""

    column: str
    lower: str
    upper: str
    count: int


@dataclass(frozen=True)
class JdbcTextSplit:
    """How a table with a text key is split: at these values of the column, one read for each stretch."""

    column: str
    bounds: tuple[str, ...]

    def predicates(self) -> list[str]:
        """Conditions that meet every row once, NULL keys with the first stretch.

        The values are compared by the database, so its collation decides; any order gives whole results.
        """
        quoted = ["'" + b.replace("'", "''") + "'" for b in sorted(set(self.bounds))]
        if not quoted:
            return ["1 = 1"]
        first = f"({self.column} IS NULL OR {self.column} < {quoted[0]})"
        between = [f"({self.column} >= {a} AND {self.column} < {b})" for a, b in zip(quoted, quoted[1:])]
        return [first, *between, f"({self.column} >= {quoted[-1]})"]


def jdbc_options(
    url: str, table: str, user: str, password: str, partition: JdbcPartition | None = None
) -> dict[str, str]:
    if not (url and user and password):
        raise ValueError("url, user and password are required")
    options = {"url": url, "dbtable": table, "user": user, "password": password}
    if partition is not None:
        options |= {
            "partitionColumn": partition.column,
            "lowerBound": str(partition.lower),
            "upperBound": str(partition.upper),
            "numPartitions": str(partition.count),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    partition: JdbcPartition | JdbcTextSplit | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table. Without ``partition`` one task reads it all, so pass one for a large table."""
    if isinstance(partition, JdbcTextSplit):
        options = jdbc_options(url, table, user, password)
        properties = {"user": options["user"], "password": options["password"], "fetchsize": str(fetch_size)}
        return spark.read.jdbc(url, table, predicates=partition.predicates(), properties=properties)
    options = jdbc_options(url, table, user, password, partition)
    return spark.read.format("jdbc").options(fetchsize=str(fetch_size), **options).load()


def hourly_day_partition(day: str, column: str = "txn_date", count: int = 24) -> JdbcPartition:
    """Range split of one day by time."""
    start = parse_day(day)
    return JdbcPartition(
        column, f"{start} 00:00:00", f"{start + timedelta(days=1)} 00:00:00", count
    )


def window_of(table: DataFrame, day: str, status: str = "COMPLETED") -> DataFrame:
    """Transaction columns of one day and status. On a JDBC table Spark sends columns and both
    filters to the database."""
    wanted = column_names(TRANSACTIONS)
    absent = [c for c in wanted if c not in table.columns]
    if absent:
        raise ValueError(f"the transactions table lacks {', '.join(absent)}")
    return table.filter(in_day("txn_date", day) & (F.col("status") == status)).select(*wanted)


def read_jdbc_window(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    day: str,
    status: str = "COMPLETED",
    partitions: int = 24,
) -> DataFrame:
    """One day of transactions of one status, filtered in the database, read in parallel."""
    split = hourly_day_partition(day, count=partitions)
    return window_of(read_jdbc(spark, url, table, user, password, split), day, status)
