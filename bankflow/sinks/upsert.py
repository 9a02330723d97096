"""Keyed upsert into a partitioned Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bankflow.session import remove_path, scratch_path
from bankflow.sinks.tables import write_snapshot


def upsert(
    target_path: str,
    updates: DataFrame,
    keys: list[str],
    partition_col: str,
    stamp: str | None = "refreshed_at",
) -> None:
    """Insert new keys, replace rows of existing keys, leave everything else.

    Only partitions named by the updates are read and rewritten. Updates and merged rows are staged
    in the shared folder: the updates are computed once, the target is not read while it is
    replaced, and the merged rows outlive a failed replacement. ``stamp`` is set to the load time
    on inserted and updated rows alike. Keys in ``updates`` must be present and unique. Columns that only
    the target has keep their values on rows that exist and are NULL on inserted ones.
    """
    spark = updates.sparkSession
    if partition_col not in keys:
        raise ValueError("the partition column must be one of the keys")
    if stamp:
        updates = updates.withColumn(stamp, F.current_timestamp())
    staged_path = scratch_path(spark, "upsert-updates")
    updates.write.parquet(staged_path)
    staged = spark.read.schema(updates.schema).parquet(staged_path)
    _check_keys(staged, keys)

    schema = _with_target_columns(spark, target_path, updates.schema)
    target = _read_if_there(spark, target_path, schema)
    if target is None:
        write_snapshot(staged, target_path, partition_col)
        return
    # The values name the folders that the commit replaces one by one on the driver anyway; as
    # literals they prune the read to those folders.
    touched = [r[0] for r in staged.select(partition_col).distinct().collect()]
    there = target.filter(F.col(partition_col).isin(touched))
    kept = there.join(staged.select(*keys), keys, "left_anti")
    own = [c for c in schema.names if c not in updates.columns]
    if own:
        staged = staged.join(there.select(*keys, *own), keys, "left").select(*schema.names)
    merged_path = scratch_path(spark, "upsert-merged")
    kept.unionByName(staged).write.partitionBy(partition_col).parquet(merged_path)
    write_snapshot(
        spark.read.schema(schema).parquet(merged_path), target_path, partition_col
    )
    for path in (staged_path, merged_path):  # kept for recovery if the replacement fails
        remove_path(spark, path)


def _check_keys(updates: DataFrame, keys: list[str]) -> None:
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    bad = updates.groupBy(*keys).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | missing)
    first = bad.head(1)
    if first:
        raise ValueError(f"updates repeat or lack a key, for example {first[0].asDict()}")


def _with_target_columns(spark: SparkSession, path: str, schema: StructType) -> StructType:
    """The schema of the updates and, behind it, the columns that only the target's files have."""
    try:
        there = spark.read.option("mergeSchema", True).parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return schema
        raise
    return StructType([*schema, *(f for f in there if f.name not in schema.names)])


def _read_if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
