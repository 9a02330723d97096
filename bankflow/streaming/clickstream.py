"""Clickstream: land, quarantine, clean, enrich, tier.

Landing has Spark's file sink, which commits a micro-batch once also after a failure. Landed events are
then read once by a query that routes each micro-batch to quarantine, silver and the enriched table: every
table has folders by batch, and a batch that is repeated after a failure replaces its own folders, so each
event is in each table once. The stages can also run as queries of their own (``write_quarantine``,
``write_events``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from bankflow.session import folders_in, make_folder, remove_path
from bankflow.sinks.staged import Staging
from bankflow.sources.events import KAFKA_PREFIX
from bankflow.streaming.contract import (
    APP_EVENT_CONTRACT,
    EventContract,
    split_valid,
    validate_events,
)
from bankflow.streaming.progress import watched_progress

# Age limits in days of the storage tiers.
HOT_DAYS = 7
WARM_DAYS = 90


def dedupe_events(
    events: DataFrame,
    delay: str = "10 minutes",
    key: str = "event_id",
    time: str = "event_timestamp",
    salts: int = 1,
) -> DataFrame:
    """One event per id among those at most ``delay`` apart; later ones than that are dropped.

    The state forgets an id once the watermark has passed it. Where single ids have very many copies,
    ask for ``salts``: copies are then reduced inside that many groups per id first, chosen by the map
    task they come from, at the price of a second state row per event.
    """
    watermarked = events.withWatermark(time, delay)
    if salts > 1:
        watermarked = (
            watermarked.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
            .dropDuplicatesWithinWatermark([key, "_salt"])
            .drop("_salt")
        )
    return watermarked.dropDuplicatesWithinWatermark([key])


def clean_events(
    raw: DataFrame, contract: EventContract = APP_EVENT_CONTRACT, delay: str = "10 minutes"
) -> DataFrame:
    """Valid events without repeats."""
    valid, _ = split_valid(validate_events(raw, contract), contract)
    valid = valid.drop(*[c for c in valid.columns if c.startswith(KAFKA_PREFIX)])
    return dedupe_events(valid, delay, time=contract.time_column)


def late_events(
    bronze: DataFrame, silver: DataFrame, contract: EventContract = APP_EVENT_CONTRACT
) -> DataFrame:
    """Batch check: valid landed events whose id never reached silver, one row per id.

    The watermark drops such events from the stream; they can be appended to silver from here. Of
    copies the earliest is given.
    """
    valid, _ = split_valid(validate_events(bronze, contract), contract)
    missing = valid.join(silver.select("event_id"), "event_id", "left_anti")
    first = F.min_by(F.struct(*missing.columns), contract.time_column).alias("e")
    return missing.groupBy("event_id").agg(first).select("e.*")


def checked_events(
    raw: DataFrame, contract: EventContract = APP_EVENT_CONTRACT, delay: str = "10 minutes"
) -> DataFrame:
    """Events with ``reason``: valid ones (NULL) without repeats, invalid ones as often as they came.

    One pass for both: invalid events go through the deduplication with a key of their own and without
    a time, so the watermark neither sees nor drops them, and their state is forgotten with the next batch.
    """
    checked = validate_events(raw, contract)
    good = F.col("reason").isNull()
    # A batch draws its ids from one seed, so a task that runs again draws the same ones.
    own = F.concat(F.lit("invalid-"), F.expr("uuid()"))
    keyed = checked.withColumn("_time", F.when(good, F.col(contract.time_column))).withColumn(
        "_key", F.when(good, F.concat(F.lit("e-"), F.col("event_id").cast("string"))).otherwise(own)
    )
    return keyed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


def quarantined_events(
    raw: DataFrame, contract: EventContract = APP_EVENT_CONTRACT
) -> DataFrame:
    """Invalid events with reason and time of arrival."""
    _, invalid = split_valid(validate_events(raw, contract), contract)
    return invalid.withColumn("ingested_at", F.current_timestamp())


def account_context(accounts: DataFrame) -> DataFrame:
    """Number of accounts and total balance per customer, one row each, so joins do not multiply.

    Daily snapshots (a table with ``snapshot_date``) are reduced to each account's latest row first.
    """
    if "snapshot_date" in accounts.columns:
        latest = F.max_by(F.struct("customer_id", "balance"), "snapshot_date").alias("a")
        accounts = accounts.groupBy("account_id").agg(latest).select("a.*")
    return accounts.groupBy("customer_id").agg(
        F.count("*").alias("account_count"), F.sum("balance").alias("total_balance")
    )


def enrich_events(
    events: DataFrame, profile: DataFrame, accounts: DataFrame, salts: int = 1
) -> DataFrame:
    """Events with segment, risk score and account context; unknown customers get NULLs.

    Inside a routed micro-batch AQE splits a hot customer's events. A streaming join has no runtime skew
    handling: there, ``salts`` repeats the customer side that many times and spreads a hot customer's
    events over as many tasks. Spark broadcasts the customer side by itself where its size is under the
    broadcast limit.
    """
    context = profile.select("customer_id", "segment", "risk_score").join(
        account_context(accounts), "customer_id", "left"
    )
    if salts <= 1:
        return events.join(context, "customer_id", "left")
    salted = context.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
        .join(salted, ["customer_id", "_salt"], "left")
        .drop("_salt")
    )


def with_event_date(events: DataFrame, time: str = "event_timestamp") -> DataFrame:
    return events.withColumn("event_date", F.to_date(time))


def tier_events(events: DataFrame, as_of: date, time: str = "event_timestamp") -> DataFrame:
    """Adds the storage tier by age in days: hot, warm or cold."""
    age = F.datediff(F.lit(as_of), F.to_date(time))
    return events.withColumn(
        "tier", F.when(age <= HOT_DAYS, "hot").when(age <= WARM_DAYS, "warm").otherwise("cold")
    )


def write_tiers(events: DataFrame, path: str, as_of: date) -> None:
    """Batch write of events into folders by tier and date; dates that come again are replaced."""
    tiered = with_event_date(tier_events(events, as_of))
    tiered.hint("rebalance", F.col("tier"), F.col("event_date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("tier", "event_date").parquet(path)


def tier_of(day: date, as_of: date) -> str:
    age = (as_of - day).days
    return "hot" if age <= HOT_DAYS else "warm" if age <= WARM_DAYS else "cold"


def tier_moves(spark: SparkSession, path: str, as_of: date) -> list[tuple[date, str, str]]:
    """Dates that lie in another tier than on ``as_of``, with both tiers, found from folder names alone."""
    moves = []
    for folder in folders_in(spark, path):
        tier = folder.removeprefix("tier=")
        for name in folders_in(spark, f"{path}/{folder}") if tier != folder else ():
            day = date.fromisoformat(name.removeprefix("event_date="))
            if tier_of(day, as_of) != tier:
                moves.append((day, tier, tier_of(day, as_of)))
    return sorted(moves)


def move_tiers(spark: SparkSession, path: str, as_of: date) -> list[tuple[date, str, str]]:
    """Move the dates that have crossed an age limit, and no others; returns the moves.

    The moved dates are read from their old folders and written to the new ones in one job each time, then
    the old folders go. A run that was cut short is made up for by the next one: a date that lies in both
    tiers is written again. Between the two steps a reader can see a moved date twice.
    """
    moves = tier_moves(spark, path, as_of)
    if not moves:
        return []
    tables = spark.read.parquet(path)
    leaving = F.lit(False)
    for tier in sorted({old for _, old, _ in moves}):
        days = [day for day, old, _ in moves if old == tier]
        leaving = leaving | ((F.col("tier") == tier) & F.col("event_date").isin(days))
    age = F.datediff(F.lit(as_of), F.col("event_date"))
    moved = tables.filter(leaving).withColumn(
        "tier", F.when(age <= HOT_DAYS, "hot").when(age <= WARM_DAYS, "warm").otherwise("cold")
    )
    moved.hint("rebalance", F.col("tier"), F.col("event_date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("tier", "event_date").parquet(path)
    for day, old, _ in moves:
        remove_path(spark, f"{path}/tier={old}/event_date={day}")
    return moves


def _start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None,
    partitions: tuple[str, ...] = (),
) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def land_events(
    raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Raw events as they came, for reprocessing."""
    return _start(raw, path, checkpoint, trigger)


def write_quarantine(
    invalid: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return _start(invalid, path, checkpoint, trigger)


def write_events(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    files_per_date: int | None = None,
) -> StreamingQuery:
    """Events in folders by date; folders by customer would be far too many and too small.

    Every task writes a file per date it holds. For small micro-batches set ``files_per_date``: each
    date then goes to that many tasks. Leave it off for a backfill, whose tasks are large already.
    """
    dated = with_event_date(events)
    if files_per_date:
        spread = F.pmod(F.xxhash64("event_id"), F.lit(files_per_date))
        dated = dated.repartition(F.col("event_date"), spread)
    return _start(dated, path, checkpoint, trigger, ("event_date",))


@dataclass(frozen=True)
class ClickstreamPaths:
    """Tables and checkpoints of one pipeline below one folder."""

    folder: str

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.folder}/_checkpoints/{name}"


def write_batch(rows: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = ()) -> None:
    """Write one micro-batch; writing the same batch again replaces it and nothing else."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partitions, "batch_id").parquet(path)


def spread_by_date(events: DataFrame, files_per_date: int | None) -> DataFrame:
    """Each date's events in that many tasks, hence files; without a number they stay where they are."""
    if not files_per_date:
        return events
    return events.repartition(
        F.col("event_date"), F.pmod(F.xxhash64("event_id"), F.lit(files_per_date))
    )


def route_events(
    bronze: DataFrame,
    paths: ClickstreamPaths,
    load_context: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
    contract: EventContract = APP_EVENT_CONTRACT,
    delay: str = "10 minutes",
    files_per_date: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """One query from landed events to quarantine, silver and (with ``load_context``) the enriched table.

    A micro-batch is stored once checked and then written to each table. The tables are written one after
    the other: after a failure in between, the batch comes again with the same number and replaces what it
    had written. ``load_context`` returns customer profile and accounts and is called for every batch.
    """
    spark = bronze.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        staging = Staging(spark)
        checked = staging.write(batch, "routed")
        valid, invalid = split_valid(checked, contract)
        write_batch(
            invalid.withColumn("ingested_at", F.current_timestamp()), paths.table("quarantine"), batch_id
        )
        clean = valid.drop(*[c for c in valid.columns if c.startswith(KAFKA_PREFIX)])
        dated = with_event_date(clean, contract.time_column)
        write_batch(spread_by_date(dated, files_per_date), paths.table("silver"), batch_id, ("event_date",))
        if load_context:
            enriched = enrich_events(dated, *load_context())
            write_batch(
                spread_by_date(enriched, files_per_date), paths.table("enriched"), batch_id, ("event_date",)
            )
        staging.drop()

    return (
        checked_events(bronze, contract, delay)
        .writeStream.queryName(f"route-{uuid.uuid4().hex[:8]}")
        .foreachBatch(write)
        .option("checkpointLocation", paths.checkpoint("routed"))
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def recover_late_events(
    spark: SparkSession,
    paths: ClickstreamPaths,
    load_context: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
    contract: EventContract = APP_EVENT_CONTRACT,
) -> int:
    """Append events that the watermark dropped to silver (and enriched); how many there were.

    Each recovery has a batch number of its own below zero, so it replaces no other. What is in silver is not
    late any more, so repeating this adds nothing. Run it while no stream writes.
    """
    staging = Staging(spark)
    bronze = spark.read.parquet(paths.table("bronze"))
    late = late_events(bronze, read_table(spark, paths, "silver"), contract)
    clean = late.drop(*[c for c in late.columns if c.startswith(KAFKA_PREFIX)])
    dated = staging.write(
        with_event_date(clean, contract.time_column), "late", late_events=F.count(F.lit(1))
    )
    number = -time.time_ns() // 1_000_000
    if load_context:  # first, as silver decides what is late
        write_batch(enrich_events(dated, *load_context()), paths.table("enriched"), number, ("event_date",))
    write_batch(dated, paths.table("silver"), number, ("event_date",))
    staging.drop()
    return staging.figures["late_events"]


def read_table(spark: SparkSession, paths: ClickstreamPaths, name: str) -> DataFrame:
    """A routed table without the number of the micro-batch that wrote a row."""
    return spark.read.parquet(paths.table(name)).drop("batch_id")


def run_clickstream(
    spark: SparkSession,
    raw: DataFrame,
    folder: str,
    load_context: Callable[[], tuple[DataFrame, DataFrame]],
    contract: EventContract = APP_EVENT_CONTRACT,
    delay: str = "10 minutes",
    files_per_date: int | None = None,
    progress_path: str | None = None,
) -> ClickstreamPaths:
    """Process what has arrived: raw to bronze, then routed to quarantine, silver and enriched.

    Both queries continue from their checkpoints, so calling this again takes up new events only.
    ``load_context`` is called per batch, so a batch joins the customer data of its time. With
    ``progress_path`` the run appends how many rows each query read and how many its watermark dropped.
    """
    paths = ClickstreamPaths(folder)
    now = {"availableNow": True}
    with watched_progress(spark, progress_path) as watch:
        watch.wait(land_events(raw, paths.table("bronze"), paths.checkpoint("bronze"), now))
        bronze = _stream_table(spark, paths.table("bronze"), raw.schema)
        watch.wait(route_events(bronze, paths, load_context, contract, delay, files_per_date, now))
    return paths


def start_clickstream(
    spark: SparkSession,
    raw: DataFrame,
    folder: str,
    load_context: Callable[[], tuple[DataFrame, DataFrame]],
    contract: EventContract = APP_EVENT_CONTRACT,
    delay: str = "10 minutes",
    files_per_date: int | None = None,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Both queries running side by side; wait for them with ``wait_for_all``."""
    paths = ClickstreamPaths(folder)
    make_folder(spark, paths.table("bronze"))
    landing = land_events(raw, paths.table("bronze"), paths.checkpoint("bronze"), trigger)
    bronze = _stream_table(spark, paths.table("bronze"), raw.schema)
    routing = route_events(bronze, paths, load_context, contract, delay, files_per_date, trigger)
    return [landing, routing]


def wait_for_all(spark: SparkSession, queries: list[StreamingQuery], seconds: float | None = None) -> None:
    """Wait until every query has ended, or the time is up; a query that fails ends the others and raises."""
    until = None if seconds is None else time.monotonic() + seconds
    try:
        while any(q.isActive for q in queries):
            left = None if until is None else until - time.monotonic()
            if left is not None and left <= 0:
                return
            spark.streams.resetTerminated()
            for query in queries:
                if not query.isActive and query.exception():
                    raise query.exception()
            spark.streams.awaitAnyTermination(min(left, 5) if left is not None else 5)
        for query in queries:
            if query.exception():
                raise query.exception()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def _stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
