"""Snapshot table and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.schemas import SNAPSHOTS, column_names


def write_snapshot(df: DataFrame, path: str, partition_col: str = "snapshot_date") -> None:
    """Replace the partitions that ``df`` has rows for and leave all others.

    The mode is an option of this write, so it does not depend on session settings. The rebalance
    gives evenly sized files whatever the partitioning before.
    """
    sized = df.hint("rebalance", F.col(partition_col))
    sized.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition_col
    ).parquet(path)


def snapshot_columns(df: DataFrame) -> DataFrame:
    """The snapshot's columns in their fixed order; columns the input lacks are left out."""
    return df.select(*[c for c in column_names(SNAPSHOTS) if c in df.columns])


def export_csv(
    df: DataFrame,
    path: str,
    columns: list[str] | None = None,
    single_file: bool | None = None,
    single_file_rows: int = 5_000_000,
) -> None:
    """CSV with a header and a fixed column order, by default all snapshot columns.

    A column that ``df`` lacks is an error: the readers of an export rely on every one. One file means that
    one task writes all rows; that is done up to ``single_file_rows`` rows, or as ``single_file`` says.
    """
    wanted = column_names(SNAPSHOTS) if columns is None else columns
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        raise ValueError(f"columns to export are missing: {', '.join(absent)}")
    chosen = df.select(*wanted)
    if single_file is None:
        single_file = chosen.limit(single_file_rows + 1).count() <= single_file_rows
    if single_file:
        chosen = chosen.repartition(1)
    chosen.write.mode("overwrite").option("header", True).csv(path)
