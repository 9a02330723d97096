import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bankflow.schemas import APP_EVENTS, column_names
from bankflow.session import scratch_path
from bankflow.streaming import clickstream
from bankflow.streaming.clickstream import (
    account_context,
    enrich_events,
    late_events,
    move_tiers,
    read_table,
    recover_late_events,
    run_clickstream,
    tier_events,
    tier_of,
    write_tiers,
)
from bankflow.streaming.progress import dropped_by_run
from bankflow.streaming.contract import split_valid, validate_events
from tests.helpers import dec, rows

RAW = APP_EVENTS.replace("event_timestamp timestamp", "event_timestamp string")


def event(event_id, when, customer="c1", kind="login", device="IOS", screen="Dashboard"):
    return (event_id, customer, when, kind, screen, "s1", device, "1.0")


def arrive(spark, folder, *events):
    spark.createDataFrame(list(events), RAW).coalesce(1).write.mode("append").parquet(folder)


def test_validation_names_every_fault(spark):
    df = spark.createDataFrame(
        [
            event("e1", "2025-08-01 10:00:00"),
            event(None, "soon", kind="dance"),
            event("e3", "2025-08-01 10:00:00", customer=None, device="TV", screen=None),
        ],
        RAW,
    )
    valid, invalid = split_valid(validate_events(df))
    assert rows(valid, "event_id") == [("e1",)] and valid.columns == column_names(RAW)
    assert {r["event_id"]: r["reason"] for r in invalid.collect()} == {
        None: "event_id is missing or unreadable; event_timestamp is missing or unreadable; "
        "event_type is unknown",
        "e3": "customer_id is missing or unreadable; device_type is unknown",
    }


@pytest.fixture(scope="module")
def context(spark):
    profile = spark.createDataFrame(
        [("c1", "MASS", 1.5)], "customer_id string, segment string, risk_score double"
    )
    accounts = spark.createDataFrame(
        [("a1", "c1", dec("1.50")), ("a2", "c1", dec("2.00"))],
        "account_id string, customer_id string, balance decimal(15,2)",
    )
    return profile, accounts


def test_replay_restart_late_and_invalid(spark, context):
    arrivals, folder = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")

    def run():
        raw = spark.readStream.schema(RAW).parquet(arrivals)
        return run_clickstream(spark, raw, folder, lambda: context, delay="10 minutes")

    arrive(
        spark, arrivals,
        event("e1", "2025-08-01 10:00:00"), event("e1", "2025-08-01 10:00:00"),
        event("e2", "2025-08-01 11:00:00", customer="stranger"),
        event(None, "2025-08-01 11:00:00"), event("e4", "not a time"),
    )
    paths = run()
    silver = spark.read.parquet(paths.table("silver"))
    assert rows(silver, "event_id") == [("e1",), ("e2",)]

    # Same checkpoint: a copy inside the delay, an event behind the watermark of 10:50, one inside.
    arrive(
        spark, arrivals,
        event("e2", "2025-08-01 11:00:00"), event("late", "2025-08-01 10:49:00"),
        event("ok", "2025-08-01 10:55:00"), event("next", "2025-08-02 00:10:00", kind="dance"),
    )
    run()
    run()
    silver = spark.read.parquet(paths.table("silver"))
    assert rows(silver, "event_id") == [("e1",), ("e2",), ("ok",)]
    bronze = spark.read.parquet(paths.table("bronze"))
    assert bronze.count() == 9
    quarantine = spark.read.parquet(paths.table("quarantine"))
    assert rows(quarantine, "event_id") == [("e4",), ("next",), (None,)]
    assert quarantine.filter(F.col("ingested_at").isNull()).count() == 0
    assert rows(quarantine.filter("event_id = 'e4'"), "raw_event_timestamp") == [("not a time",)]
    assert rows(late_events(bronze, silver), "event_id") == [("late",)]
    enriched = spark.read.parquet(paths.table("enriched"))
    assert rows(enriched, "event_id", "segment", "account_count", "total_balance") == [
        ("e1", "MASS", 2, dec("3.50")), ("e2", None, None, None), ("ok", "MASS", 2, dec("3.50")),
    ]

    assert recover_late_events(spark, paths, lambda: context) == 1
    assert recover_late_events(spark, paths, lambda: context) == 0
    for table in ("silver", "enriched"):
        got = rows(read_table(spark, paths, table), "event_id")
        assert got == [("e1",), ("e2",), ("late",), ("ok",)]


class Killed(RuntimeError):
    pass


def test_batch_that_dies_between_two_tables(spark, context, monkeypatch):
    arrivals, folder = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    arrive(
        spark, arrivals,
        event("e1", "2025-08-01 10:00:00"), event("e1", "2025-08-01 10:00:00"),
        event(None, "2025-08-01 11:00:00"), event(None, "2025-08-01 11:00:00"),
    )

    def run():
        raw = spark.readStream.schema(RAW).parquet(arrivals)
        return run_clickstream(spark, raw, folder, lambda: context)

    plain = clickstream.write_batch
    written = []

    def dies(rows_, path, *more):
        if path.endswith("silver"):
            raise Killed("between quarantine and silver")
        written.append(path)
        plain(rows_, path, *more)

    monkeypatch.setattr(clickstream, "write_batch", dies)
    with pytest.raises(Exception, match="between quarantine and silver"):
        run()
    assert len(written) == 1 and spark.read.parquet(f"{folder}/quarantine").count() == 2
    monkeypatch.setattr(clickstream, "write_batch", plain)
    paths = run()
    assert spark.read.parquet(paths.table("quarantine")).count() == 2
    assert rows(read_table(spark, paths, "silver"), "event_id") == [("e1",)]
    assert rows(read_table(spark, paths, "enriched"), "event_id", "segment") == [("e1", "MASS")]


def test_dropped_rows_are_counted_for_each_run(spark, context):
    arrivals, folder = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")

    def run(*events):
        arrive(spark, arrivals, *events)
        raw = spark.readStream.schema(RAW).parquet(arrivals)
        run_clickstream(spark, raw, folder, lambda: context, progress_path=f"{folder}/progress")

    run(event("e1", "2025-08-01 10:00:00"), event("bad", "never"))
    run(event("late", "2025-08-01 09:00:00"), event("ok", "2025-08-01 09:55:00"), event("bad", "never"))
    counted = dropped_by_run(spark.read.parquet(f"{folder}/progress"))
    # Landing and routing read each row once.
    assert rows(counted, "input_rows", "dropped_by_watermark") == [(4, 0), (6, 1)]


def test_only_dates_that_cross_a_limit_move(spark):
    path = scratch_path(spark, "tiers")
    days = [date(2025, 8, 1) - timedelta(days=n) for n in (0, 6, 7, 8, 89, 90, 91)]
    events = spark.createDataFrame([(f"e{d}", str(d)) for d in days], "event_id string, t string").select(
        "event_id", F.col("t").cast("timestamp").alias("event_timestamp")
    )
    write_tiers(events, path, date(2025, 8, 1))
    local = path.removeprefix("file:")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.endswith(".parquet")}

    before = files()
    moves = move_tiers(spark, path, date(2025, 8, 2))
    assert moves == [(days[5], "warm", "cold"), (days[2], "hot", "warm")]
    assert len(before & files()) == 5 and len(files()) == 7
    assert move_tiers(spark, path, date(2025, 8, 2)) == []
    got = {(r["event_id"], r["tier"]) for r in spark.read.parquet(path).collect()}
    assert got == {(f"e{d}", tier_of(d, date(2025, 8, 2))) for d in days}
    assert move_tiers(spark, scratch_path(spark, "none"), date(2025, 8, 2)) == []


def test_enrichment_keeps_one_row_per_event(spark, context):
    profile, accounts = context
    events = spark.createDataFrame(
        [(f"e{i}", "c1" if i % 3 else "x") for i in range(60)],
        "event_id string, customer_id string",
    )
    got = enrich_events(events, profile, accounts, salts=5)
    assert got.count() == 60
    assert got.filter("segment is not null").count() == 40
    assert rows(account_context(accounts)) == [("c1", 2, dec("3.50"))]
    old = accounts.withColumn("snapshot_date", F.lit("2025-07-31")).withColumn("balance", F.lit(9))
    daily = old.unionByName(accounts.withColumn("snapshot_date", F.lit("2025-08-01")))
    assert rows(account_context(daily)) == [("c1", 2, dec("3.50"))]


def test_tiers(spark):
    days = {"2025-08-01": "hot", "2025-07-25": "hot", "2025-07-24": "warm", "2025-05-03": "warm",
            "2025-05-02": "cold", "2025-08-02": "hot"}
    df = spark.createDataFrame([(t,) for t in days], "t string").select(
        F.col("t").cast("timestamp").alias("event_timestamp"), "t"
    )
    got = tier_events(df, date(2025, 8, 1)).select("t", "tier").collect()
    assert {r["t"]: r["tier"] for r in got} == days
