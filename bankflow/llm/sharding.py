"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. With one more shard,
a key either stays or goes to the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bankflow.llm.common import stage


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys jump until they pass the last shard."""
    state = keys.astype(np.uint64).copy()
    bucket = np.full(len(state), -1, np.int64)
    target = np.zeros(len(state), np.int64)
    open_rows = np.arange(len(state))
    while len(open_rows):
        bucket[open_rows] = target[open_rows]
        state[open_rows] = state[open_rows] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[open_rows] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[open_rows] = np.floor((bucket[open_rows] + 1) * step).astype(np.int64)
        open_rows = open_rows[target[open_rows] < shards]
    return bucket.astype(np.int32)


def jump_column(key, shards: int):
    """Column form; ``key`` is any column, null included (hashed by Spark's xxhash64)."""

    @pandas_udf("int")
    def shard(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards))

    return shard(F.xxhash64(key))


def shard_documents(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", extra_bytes: int = 16
) -> DataFrame:
    """Key, size, text checksum, shard, slot and the shard with one shard more, for every row.

    ``size`` is the UTF-8 length of the text (0 for null) plus ``extra_bytes``. Slots are gapless from 0
    within a shard; they follow the input partitions, not the key, so no shard is gathered or sorted in
    one task. Rows with equal keys share a shard, null keys too; an empty table gives an empty result.
    Other columns are left out, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(words) + F.lit(extra_bytes)).cast("long").alias("size"),
        F.crc32(F.encode(words, "UTF-8")).alias("text_crc32"),
        jump_column(F.col(key), shards).alias("shard"),
        jump_column(F.col(key), shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    placed = stage(rows, "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("shard", "part").orderBy(F.col("key").asc_nulls_first(), "text_crc32")
    return placed.join(starts, ["shard", "part"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )
