"""The row before, per key, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(
    df: DataFrame, key: str, order: list[str], columns: list[str], part: Column
) -> DataFrame:
    """Adds ``previous_<column>`` from the key's row before in ``order``.

    ``part`` must never decrease along ``order`` (for dates, their month). Rows look back inside
    their part; only the first row of a part needs the last row of the part before, and those last
    rows are one per key and part. So a hot key is spread over its parts, and the rows move once:
    the join has the keys of the window.
    """
    parted = df.withColumn("_part", part)
    wanted = F.struct(*columns)
    inside = Window.partitionBy(key, "_part").orderBy(*[F.asc_nulls_first(c) for c in order])
    from_end = Window.partitionBy(key, "_part").orderBy(*[F.desc_nulls_last(c) for c in order])
    over_parts = Window.partitionBy(key).orderBy("_part")
    carried = (
        parted.select(key, "_part", *order, wanted.alias("_last"))
        .withColumn("_rn", F.row_number().over(from_end))
        .filter("_rn = 1")
        .select(key, "_part", F.lag("_last").over(over_parts).alias("_carried"))
    )
    before = F.coalesce("_inside", "_carried")
    return (
        parted.withColumn("_inside", F.lag(wanted).over(inside))
        .join(carried, [key, "_part"], "left")
        .select(*df.columns, *[before[c].alias(f"previous_{c}") for c in columns])
    )
