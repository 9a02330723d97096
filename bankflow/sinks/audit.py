"""Run audit and lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bankflow.schemas import COLUMN_LINEAGE, PIPELINE_RUNS


def record_run(spark: SparkSession, path: str, run: dict) -> None:
    """Append one run; fields the caller leaves out are NULL."""
    _append(spark, path, [run], PIPELINE_RUNS)


def record_lineage(spark: SparkSession, path: str, edges: list[dict] | DataFrame) -> None:
    """Append lineage edges."""
    if isinstance(edges, DataFrame):
        edges.write.mode("append").parquet(path)
    else:
        _append(spark, path, edges, COLUMN_LINEAGE)


def lineage_edges(
    pipeline: str,
    run_id: str,
    target: str,
    made_from: dict[str, tuple[str, tuple[str, ...]]],
    source_system: str = "bank",
) -> list[dict]:
    """Edges of one run; ``made_from`` gives each target column its source table and columns."""
    return [
        {
            "source_system": source_system, "source_table": table, "source_column": column,
            "target_table": target, "target_column": name,
            "pipeline_name": pipeline, "run_id": run_id,
        }
        for name, (table, columns) in made_from.items()
        for column in columns
    ]


def _append(spark: SparkSession, path: str, rows: list[dict], ddl: str) -> None:
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    unknown = {key for row in rows for key in row} - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    values = [tuple(row.get(name) for name in schema.names) for row in rows]
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(path)
