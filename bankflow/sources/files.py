"""CSV and Parquet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bankflow.functions import parse_day


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | StructType | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with a header. Give the schema where it is known: inference reads the data twice.

    The header must name the schema's columns in their order, and values that do not parse fail the
    read; ``mode`` may be ``PERMISSIVE`` for files known to hold bad values, which become NULL.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", mode)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshot dates; the date column comes from the folders."""
    return spark.read.parquet(path)


def read_snapshot_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One snapshot date, its date column kept; only that folder is read."""
    return read_snapshots(spark, path).filter(F.col("snapshot_date") == F.lit(parse_day(day)))
