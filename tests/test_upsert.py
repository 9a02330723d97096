import os

import pytest
from pyspark.sql import functions as F

from bankflow.session import scratch_path, shared_folder
from bankflow.sinks import record_lineage, record_run, upsert
from tests.helpers import d, rows

SCHEMA = "month_start date, customer_id string, value int"
KEYS = ["month_start", "customer_id"]


def load(spark, target, *items):
    updates = spark.createDataFrame([(d(m), c, v) for m, c, v in items], SCHEMA)
    upsert(target, updates, KEYS, "month_start")
    return spark.read.parquet(target)


def test_insert_update_and_untouched_partitions(spark):
    target = scratch_path(spark, "t")
    load(spark, target, ("2025-01-01", "a", 1), ("2025-02-01", "a", 2), ("2025-02-01", "b", 3))
    january = f"{target.removeprefix('file:')}/month_start=2025-01-01"
    before = {f: os.stat(f"{january}/{f}").st_mtime_ns for f in os.listdir(january)}
    got = load(spark, target, ("2025-02-01", "b", 30), ("2025-02-01", "c", 4),
               ("2025-03-01", "a", 5))
    assert rows(got.select(*KEYS, "value")) == [
        (d("2025-01-01"), "a", 1), (d("2025-02-01"), "a", 2), (d("2025-02-01"), "b", 30),
        (d("2025-02-01"), "c", 4), (d("2025-03-01"), "a", 5),
    ]
    assert before == {f: os.stat(f"{january}/{f}").st_mtime_ns for f in os.listdir(january)}


def test_rerun_changes_only_the_stamp(spark):
    target = scratch_path(spark, "t")
    items = [("2025-01-01", "a", 1), ("2025-01-01", "b", None)]
    first = [tuple(r) for r in load(spark, target, *items).orderBy("customer_id").collect()]
    again = load(spark, target, *items)
    second = [tuple(r) for r in again.orderBy("customer_id").collect()]
    at = again.columns.index("refreshed_at")
    for a, b in zip(first, second, strict=True):
        assert a[:at] + a[at + 1:] == b[:at] + b[at + 1:] and a[at] < b[at]


@pytest.mark.parametrize("bad", [("2025-01-01", "a", 2), ("2025-01-01", None, 2)])
def test_bad_keys_are_refused(spark, bad):
    target = scratch_path(spark, "t")
    load(spark, target, ("2025-01-01", "z", 1))
    with pytest.raises(ValueError):
        load(spark, target, ("2025-01-01", "a", 1), bad)
    assert spark.read.parquet(target).count() == 1


def test_partition_column_must_be_a_key(spark):
    df = spark.createDataFrame([(d("2025-01-01"), "a", 1)], SCHEMA)
    with pytest.raises(ValueError):
        upsert(scratch_path(spark, "t"), df, ["customer_id"], "month_start")


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark) + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_audit_and_lineage_append(spark):
    path = scratch_path(spark, "t")
    record_run(spark, path, {"run_id": "r1", "row_count": 3})
    record_run(spark, path, {"run_id": "r2"})
    assert rows(spark.read.parquet(path).select("run_id", "row_count")) == [
        ("r1", 3), ("r2", None)
    ]
    with pytest.raises(ValueError):
        record_run(spark, path, {"unknown": 1})
    edges = scratch_path(spark, "t")
    record_lineage(spark, edges, [{"source_table": "ACCOUNTS", "target_table": "bronze.accounts"}])
    record_lineage(spark, edges, spark.read.parquet(edges).withColumn("run_id", F.lit("r")))
    assert spark.read.parquet(edges).count() == 2


def test_columns_that_only_the_target_has_survive(spark):
    target = scratch_path(spark, "t")
    first = spark.createDataFrame(
        [(d("2025-01-01"), "a", 1, "keep1"), (d("2025-01-01"), "b", 2, "keep2")], SCHEMA + ", extra string"
    )
    upsert(target, first, KEYS, "month_start")
    got = load(spark, target, ("2025-01-01", "a", 10), ("2025-01-01", "c", 3))
    assert rows(got.select("customer_id", "value", "extra")) == [
        ("a", 10, "keep1"), ("b", 2, "keep2"), ("c", 3, None),
    ]
