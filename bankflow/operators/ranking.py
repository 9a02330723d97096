"""Row numbers over a whole table in a given order, without gathering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankflow.session import scratch_path

_WITHIN = 33  # bits that Spark gives the row inside a partition


def with_row_number(
    df: DataFrame, order: list[Column], name: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... over all rows by ``order``.

    Rows are dealt out by ranges of the order and sorted inside each; a row's number is its place in its
    range plus the rows of the ranges before. Only one small row per range meets in a task. Rows that are
    equal in ``order`` are told apart by where they came from, so they too spread over ranges; their
    numbers among each other are arbitrary but the same whenever the result is read, as the sorted rows
    are written to the shared folder. ``df`` is computed twice, once for the sample that cuts the ranges:
    hand over a stored table where that is dear. An empty table stays empty.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(count, *order, F.col("_tie")).sortWithinPartitions(*order, "_tie")
    placed = dealt.drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    path = scratch_path(spark, "ranked")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)

    part = F.shiftright("_place", _WITHIN)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND((1 << _WITHIN) - 1)
    # One row per range: bounded by ``partitions`` whatever the table's size.
    joined = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, (F.col("_before") + inside + 1).cast("bigint")).select(*df.columns, name)
