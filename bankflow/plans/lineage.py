"""Trace of column lineage over declared edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.session import scratch_path

_NODE = ["table_name", "column_name"]


def trace_upstream(edges: DataFrame, table: str, column: str, max_hops: int | None = None) -> DataFrame:
    """Every column the given one is derived from, with its least number of hops.

    Each round joins the edges with the columns found in the round before and drops those already
    known, so cycles end; a limit of hops is optional. A round is written to the shared folder: later rounds read it back, which
    keeps plans short and survives lost executors.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "lineage")
    links = edges.select(
        F.col("target_table").alias("_to_table"),
        F.col("target_column").alias("_to_column"),
        F.col("source_table").alias("table_name"),
        F.col("source_column").alias("column_name"),
    )
    start = spark.range(1).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name")
    )
    start.withColumn("hop", F.lit(0)).write.parquet(f"{folder}/round=0")
    schema = "table_name string, column_name string, hop int, round int"

    def found() -> DataFrame:
        return spark.read.schema(schema).parquet(folder)

    for hop in count(1):
        if max_hops is not None and hop > max_hops:
            raise ValueError(f"lineage of {table}.{column} is deeper than {max_hops} hops")
        known = found()
        last = known.filter(F.col("round") == hop - 1).select(
            F.col("table_name").alias("_to_table"), F.col("column_name").alias("_to_column")
        )
        step = (
            links.join(last, ["_to_table", "_to_column"])
            .select(*_NODE)
            .distinct()
            .join(known.select(*_NODE), _NODE, "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        step.write.parquet(f"{folder}/round={hop}")
        if found().filter(F.col("round") == hop).isEmpty():
            break
    return found().filter("hop > 0").drop("round")
