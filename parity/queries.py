"""Registered queries: each runs an operator over the whole test tables.

Decimals leave as doubles and times as epoch microseconds, the forms both engines print alike.
Amounts that the checking engine would round in floating point are given as exact parts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.functions import (
    change_ratio,
    micros,
    risk_flag,
    utilisation,
)
from bankflow.operators import activity, alerts, balances, clean, detectors, locations, quality
from bankflow.operators import rules, scaffold, scores
from bankflow.plans import account_snapshot as snap
from bankflow.plans import scorecard as card
from bankflow.plans.fraud import fraud_alerts, fraud_alerts_by_rule
from bankflow.plans.lineage import trace_upstream
from bankflow.schemas import DEVICES, SCREENS
from bankflow.session import scratch_path
from bankflow.sinks import export_csv, upsert
from bankflow.sinks.staged import Staging
from bankflow.sources import read_csv, read_events_stream, read_snapshot_day, read_snapshots
from bankflow.streaming import clickstream as stream
from bankflow.streaming.contract import EventContract, split_valid, validate_events
from bankflow.streaming.progress import dropped_by_run
from parity.fixtures import Bank

DAY = "1998-03-02"
RUN_MONTH = "1998-03-01"
# The reference thresholds select nothing on the test events, see FIXTURES.md.
MIN_COUNT = 3
DAYS = 7
HOME_SHARE = 50
EVENT_CONTRACT = EventContract(
    required=("event_id", "customer_id", "event_timestamp", "event_type"),
    domains={"event_type": ("view", "click", "signup", "purchase")},
)
TIER_DAY = date(2024, 4, 5)
NEXT_TIER_DAY = date(2024, 4, 12)
# The fixture's accounts lack three columns of the full layout.
SNAPSHOT_EXPORT = [
    "snapshot_date", "account_id", "customer_id", "account_type", "balance", "credit_limit",
    "daily_net_amount", "daily_txn_count",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(build: Callable[[Bank], DataFrame]) -> Callable[[Bank], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(Bank(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times as microseconds, lists as text."""
    columns = []
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(field.name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind.startswith("timestamp"):
            column = micros(column)
        elif kind.startswith("array"):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# -- snapshot -------------------------------------------------------------------------------


@register
def account_snapshot_day(bank: Bank) -> DataFrame:
    return snap.account_snapshot(bank.accounts, bank.transactions, DAY)


@register
def daily_activity(bank: Bank) -> DataFrame:
    return activity.daily_activity(activity.completed(bank.transactions))


@register
def dq_report(bank: Bank) -> DataFrame:
    """The gate's figures, observed while the snapshot of the day is staged."""
    staging = Staging(bank.spark)
    snap.stage_snapshot(staging, bank.accounts, bank.transactions, DAY)
    staging.drop()
    return quality.observed_report(bank.spark, staging.figures)


@register
def partition_counts(bank: Bank) -> DataFrame:
    return quality.partition_counts(bank.snapshots)


@register
def orphan_transactions(bank: Bank) -> DataFrame:
    # Loans stand for accounts that are missing from the account table.
    known = bank.accounts.filter(F.col("account_type") != "LOAN")
    return quality.orphan_transactions(bank.transactions, known)


def _snapshot_history(bank: Bank) -> DataFrame:
    net = activity.completed(bank.transactions).groupBy(
        "account_id", F.to_date("txn_date").alias("snapshot_date")
    ).agg(F.sum("amount").alias("daily_net_amount"), F.count("txn_id").alias("daily_txn_count"))
    return bank.snapshots.join(net, ["account_id", "snapshot_date"], "left").fillna(
        {"daily_net_amount": 0, "daily_txn_count": 0}
    )


@register
def snapshot_rerun(bank: Bank) -> DataFrame:
    """Two days published, the first one twice; the table holds each day once."""
    target = scratch_path(bank.spark, "snapshots")
    for day in (DAY, "1998-03-03", DAY):
        snap.run_account_snapshot(bank.accounts, bank.transactions, day, target)
    return read_snapshots(bank.spark, target)


@register
def snapshot_day_scan(bank: Bank) -> DataFrame:
    target = scratch_path(bank.spark, "snapshots")
    for day in (DAY, "1998-03-03"):
        snap.run_account_snapshot(bank.accounts, bank.transactions, day, target)
    return read_snapshot_day(bank.spark, target, DAY)


@register
def snapshot_export(bank: Bank) -> DataFrame:
    """One day exported as CSV and read back with its schema."""
    day = snap.account_snapshot(bank.accounts, bank.transactions, DAY)
    path = scratch_path(bank.spark, "export")
    export_csv(day, path, SNAPSHOT_EXPORT)
    return read_csv(
        bank.spark,
        path,
        "snapshot_date date, account_id string, customer_id bigint, account_type string, "
        "balance decimal(15,2), credit_limit decimal(15,2), daily_net_amount decimal(15,2), "
        "daily_txn_count bigint",
    )


@register
def run_audit(bank: Bank) -> DataFrame:
    audit = scratch_path(bank.spark, "audit")
    snap.run_account_snapshot(
        bank.accounts, bank.transactions, DAY, scratch_path(bank.spark, "snapshots"), audit
    )
    return bank.spark.read.parquet(audit).select(
        "pipeline_name", "snapshot_date", "source", "row_count", "dq_status", "job_status"
    )


@register
def lineage_of_run(bank: Bank) -> DataFrame:
    """Where a snapshot column comes from: edges the run wrote, and behind them each amount's order."""
    lineage = scratch_path(bank.spark, "lineage")
    snap.run_account_snapshot(
        bank.accounts, bank.transactions, DAY, scratch_path(bank.spark, "snapshots"),
        lineage_path=lineage,
    )
    orders = bank.raw("orders").select(
        F.lit("orders").alias("source_table"),
        F.col("o_orderkey").cast("string").alias("source_column"),
        F.lit("transactions").alias("target_table"),
        F.lit("amount").alias("target_column"),
    )
    written = bank.spark.read.parquet(lineage).select(*orders.columns)
    return trace_upstream(written.unionByName(orders), "account_snapshots", "daily_net_amount")


# -- scorecard ------------------------------------------------------------------------------


@register
def latest_snapshot_per_month(bank: Bank) -> DataFrame:
    return balances.latest_per_month(bank.snapshots)


@register
def customer_month_balance(bank: Bank) -> DataFrame:
    return balances.month_balance(bank.snapshots)


@register
def txn_type_counts(bank: Bank) -> DataFrame:
    return activity.txn_type_counts(bank.transactions, bank.accounts)


@register
def txn_type_counts_filter(bank: Bank) -> DataFrame:
    return activity.txn_type_counts(bank.transactions, bank.accounts, style="filter")


@register
def channel_amount_sums(bank: Bank) -> DataFrame:
    monthly = activity.monthly_activity(bank.transactions, bank.accounts)
    return monthly.drop(*activity.TYPE_COUNTS)


@register
def channel_avg_amount(bank: Bank) -> DataFrame:
    """Unrounded means, compared at six fractional digits."""
    means = activity.channel_avg(bank.transactions, bank.accounts)
    return means.select(
        "month_start",
        "customer_id",
        *[F.round(c, 6).alias(c) for c in activity.CHANNEL_MEANS],
    )


@register
def channel_avg_amount_filter(bank: Bank) -> DataFrame:
    return activity.channel_avg(bank.transactions, bank.accounts, scale=2)


@register
def report_months(bank: Bank) -> DataFrame:
    return scaffold.report_months(bank.snapshots)


@register
def customer_month_scaffold(bank: Bank) -> DataFrame:
    return scaffold.customer_months(bank.customers, scaffold.report_months(bank.snapshots))


@register
def scores_before_month(bank: Bank) -> DataFrame:
    return scores.scores_before(bank.scores, scaffold.report_months(bank.snapshots))


@register
def score_asof_month(bank: Bank) -> DataFrame:
    months = scaffold.report_months(bank.snapshots)
    return scores.asof_latest(bank.scores, months, method="rank")


@register
def score_asof_month_interval(bank: Bank) -> DataFrame:
    return scores.asof_latest(bank.scores, scaffold.report_months(bank.snapshots))


def _balance_grid(bank: Bank) -> DataFrame:
    months = scaffold.report_months(bank.snapshots)
    grid = scaffold.assemble_month(
        scaffold.customer_months(bank.customers, months), balances.month_balance(bank.snapshots)
    )
    wide = "decimal(20,2)"
    return grid.select(
        "month_start",
        "customer_id",
        F.coalesce("total_balance", F.lit(0)).cast(wide).alias("total_balance"),
        F.col("credit_card_balance").cast(wide).alias("credit_card_balance"),
        F.col("total_credit_limit").cast(wide).alias("total_credit_limit"),
    )


@register
def mom_balance(bank: Bank) -> DataFrame:
    with_previous = balances.with_previous(_balance_grid(bank))
    return with_previous.select(
        "month_start",
        "customer_id",
        "total_balance",
        "previous_month_balance",
        (F.col("total_balance") - F.col("previous_month_balance")).alias("mom_balance_change"),
        F.round(change_ratio("total_balance", "previous_month_balance"), 4).alias(
            "mom_balance_change_pct"
        ),
    )


@register
def credit_utilization(bank: Bank) -> DataFrame:
    used = utilisation("credit_card_balance", "total_credit_limit")
    return _balance_grid(bank).select(
        "month_start", "customer_id", F.round(used, 4).alias("credit_utilization")
    )


def _scorecard(bank: Bank) -> DataFrame:
    return card.scorecard(
        bank.customers, bank.snapshots, bank.accounts, bank.transactions, bank.scores
    )


@register
def risk_flag_months(bank: Bank) -> DataFrame:
    used = utilisation("credit_card_balance", "total_credit_limit")
    change = change_ratio("total_balance", "previous_month_balance")
    months = scaffold.report_months(bank.snapshots)
    known = scores.asof_latest(bank.scores, months)
    return (
        # The scores join before the window, while grid and balances still lie by customer and month.
        balances.with_previous(scaffold.assemble_month(_balance_grid(bank), known))
        .select(
            "month_start",
            "customer_id",
            risk_flag(used, "probability_of_default", change).alias("risk_flag"),
        )
    )


@register
def customer_scorecard(bank: Bank) -> DataFrame:
    return _scorecard(bank)


@register
def scorecard_preview(bank: Bank) -> DataFrame:
    """The first rows of the report in its order."""
    return snap.preview(card.order_scorecard(_scorecard(bank)), 10)


@register
def scorecard_rank(bank: Bank) -> DataFrame:
    """Every row's place in the report, numbered without gathering the report in one task."""
    ranked = card.rank_scorecard(_scorecard(bank).select("month_start", "customer_id", "risk_flag"))
    return ranked.select("month_start", "customer_id", "risk_flag", "row_number")


@register
def scorecard_summary(bank: Bank) -> DataFrame:
    return card.scorecard_summary(_scorecard(bank))


@register
def customer_coverage(bank: Bank) -> DataFrame:
    return scaffold.customer_coverage(bank.customers, bank.accounts)


def _scorecard_month(bank: Bank, month: str) -> DataFrame:
    return card.scorecard_month(
        bank.customers, bank.snapshots, bank.accounts, bank.transactions, bank.scores, month
    )


@register
def scorecard_month(bank: Bank) -> DataFrame:
    return _scorecard_month(bank, RUN_MONTH)


@register
def scorecard_upsert(bank: Bank) -> DataFrame:
    """Two months loaded, the later one twice; each customer-month is there once."""
    target = scratch_path(bank.spark, "scorecard")
    bank.store("accounts", "scores")  # every load reads all of both
    for month in ("1998-02-01", RUN_MONTH, RUN_MONTH):
        upsert(
            target,
            _scorecard_month(bank, month),
            keys=["month_start", "customer_id"],
            partition_col="month_start",
        )
    return bank.spark.read.parquet(target).drop("refreshed_at")


# -- fraud ----------------------------------------------------------------------------------


def _locations(bank: Bank) -> DataFrame:
    return locations.assign_city(
        bank.txn_events, bank.event_accounts, bank.customers, home_share=HOME_SHARE
    )


@register
def city_list(bank: Bank) -> DataFrame:
    return locations.city_list(bank.customers)


@register
def merchant_city(bank: Bank) -> DataFrame:
    return locations.assign_city(bank.txn_events, bank.event_accounts, bank.customers)


@register
def rolling_count_1h(bank: Bank) -> DataFrame:
    return detectors.rolling_count(bank.txn_events, bank.event_accounts)


@register
def rolling_average_days(bank: Bank) -> DataFrame:
    rolled = detectors.rolling_average_before(bank.txn_events, bank.event_accounts, days=DAYS)
    return rolled.select("customer_id", "txn_id", "amount", "window_rows", "window_sum")


@register
def rolling_count_1h_sliced(bank: Bank) -> DataFrame:
    """Every key treated as a hot one."""
    return detectors.rolling_count(bank.txn_events, bank.event_accounts, hot_rows=0)


@register
def rolling_average_days_sliced(bank: Bank) -> DataFrame:
    rolled = detectors.rolling_average_before(
        bank.txn_events, bank.event_accounts, days=DAYS, hot_rows=0
    )
    return rolled.select("customer_id", "txn_id", "amount", "window_rows", "window_sum")


@register
def fraud_high_frequency(bank: Bank) -> DataFrame:
    return detectors.high_frequency(bank.txn_events, bank.event_accounts, min_count=MIN_COUNT)


@register
def fraud_multi_city(bank: Bank) -> DataFrame:
    return detectors.multi_city(bank.txn_events, bank.event_accounts, _locations(bank))


@register
def fraud_high_amount(bank: Bank) -> DataFrame:
    return detectors.high_amount(bank.txn_events, bank.event_accounts, days=DAYS)


def _alerts(bank: Bank) -> DataFrame:
    return fraud_alerts(
        bank.txn_events, bank.event_accounts, _locations(bank), min_count=MIN_COUNT, days=DAYS
    )


@register
def fraud_alert_rows(bank: Bank) -> DataFrame:
    """All alerts; of the JSON details the parts that print alike in both engines."""
    return _alert_details(alerts.order_alerts(_alerts(bank)))


def _alert_details(found: DataFrame) -> DataFrame:
    details = F.from_json(
        "details_json",
        "max_transactions_in_1h bigint, city_count bigint, cities array<string>, txn_id bigint, "
        "amount decimal(15,2), avg_amount_30d decimal(20,2), ratio_to_avg decimal(20,2)",
    )
    return found.select("customer_id", "alert_type", "alert_date", details.alias("d")).select("customer_id", "alert_type", "alert_date", "d.*")


@register
def fraud_alert_rows_by_rule(bank: Bank) -> DataFrame:
    """The rules one by one, without the shared sweep."""
    found = fraud_alerts_by_rule(
        bank.txn_events, bank.event_accounts, _locations(bank), min_count=MIN_COUNT, days=DAYS
    )
    return _alert_details(found)


@register
def alert_rank(bank: Bank) -> DataFrame:
    """Every alert's place in the report."""
    txn_id = F.get_json_object("details_json", "$.txn_id").cast("bigint")
    return alerts.rank_alerts(_alerts(bank), txn_id).select(
        "customer_id", "alert_type", "alert_date", txn_id.alias("txn_id"), "row_number"
    )


def _bursts(bank: Bank) -> DataFrame:
    """The events with their days shrunk to hours, so that the default thresholds find something."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("txn_date").cast("timestamp")) / 24))
    return bank.txn_events.withColumn("txn_date", at.cast("timestamp_ntz"))


@register
def fraud_alerts_default(bank: Bank) -> DataFrame:
    """Default thresholds: five in an hour, three cities, homes at 95 percent."""
    bursts = _bursts(bank)
    places = locations.assign_city(bursts, bank.event_accounts, bank.customers)
    return _alert_details(fraud_alerts(bursts, bank.event_accounts, places)).drop(
        "txn_id", "amount", "avg_amount_30d", "ratio_to_avg"
    )


@register
def fraud_high_amount_default(bank: Bank) -> DataFrame:
    """Default thresholds: three times the mean of 30 days, after 30 days."""
    return detectors.high_amount(bank.transactions, bank.accounts)


@register
def alert_counts(bank: Bank) -> DataFrame:
    return alerts.alert_counts(_alerts(bank))


# -- clickstream ----------------------------------------------------------------------------


def _raw_event_stream(bank: Bank) -> DataFrame:
    """The events as a stream in which every event arrives twice."""
    arrived = read_events_stream(
        bank.spark,
        "parquet",
        {"pathGlobFilter": "events.parquet"},
        bank.raw("events").schema,
        bank.sf_dir,
    )
    return arrived.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy"), *arrived.columns
    ).select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_timestamp"),
        "event_type",
        "props",
    )


def _run_stream(bank: Bank) -> stream.ClickstreamPaths:
    def context() -> tuple[DataFrame, DataFrame]:
        profile = bank.customers.join(bank.kyc.select("customer_id", "risk_score"), "customer_id")
        return profile, bank.snapshots

    return stream.run_clickstream(
        bank.spark,
        _raw_event_stream(bank),
        scratch_path(bank.spark, "clickstream"),
        context,
        contract=EVENT_CONTRACT,
        files_per_date=2,
    )


@register
def events_clean(bank: Bank) -> DataFrame:
    return stream.read_table(bank.spark, _run_stream(bank), "silver")


@register
def events_quarantine(bank: Bank) -> DataFrame:
    return stream.read_table(bank.spark, _run_stream(bank), "quarantine").drop("ingested_at")


@register
def events_quarantine_domains(bank: Bank) -> DataFrame:
    """All three value domains at work, on screens and devices made from the user and the event."""
    events = bank.raw("events").select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_timestamp"),
        "event_type",
        F.get(F.array(*[F.lit(x) for x in SCREENS]), (F.col("user_id") % 10).cast("int")).alias("screen_name"),
        F.get(
            F.array(*[F.lit(x) for x in (*DEVICES, "TV", None)]), (F.col("event_id") % 5).cast("int")
        ).alias("device_type"),
    ).withColumn("screen_name", F.when(F.col("customer_id") % 10 == 9, "Lobby").otherwise(F.col("screen_name")))
    contract = EventContract(
        required=EVENT_CONTRACT.required,
        domains=EVENT_CONTRACT.domains | {"screen_name": SCREENS, "device_type": DEVICES},
    )
    _, invalid = split_valid(validate_events(events, contract), contract)
    return invalid.drop("raw_event_timestamp")


@register
def events_late(bank: Bank) -> DataFrame:
    """Every twentieth event comes in a second run; what the watermark drops there, and how many it counted."""
    folder = scratch_path(bank.spark, "late")
    events = bank.raw("events").select(
        "event_id", F.col("user_id").alias("customer_id"), F.col("ts").alias("event_timestamp"), "event_type"
    )
    second = F.col("event_id") % 20 == 0
    for run in (~second, second):
        events.filter(run).write.mode("append").parquet(f"{folder}/arrivals")
        paths = stream.run_clickstream(
            bank.spark,
            read_events_stream(bank.spark, "parquet", schema=events.schema, path=f"{folder}/arrivals"),
            f"{folder}/tables",
            None,
            contract=EVENT_CONTRACT,
            progress_path=f"{folder}/progress",
        )
    bronze = bank.spark.read.parquet(paths.table("bronze"))
    late = stream.late_events(bronze, stream.read_table(bank.spark, paths, "silver"), EVENT_CONTRACT)
    counted = dropped_by_run(bank.spark.read.parquet(f"{folder}/progress"))
    total = counted.agg(F.sum("dropped_by_watermark")).scalar()
    return late.withColumn("dropped_by_watermark", total)


@register
def events_enriched(bank: Bank) -> DataFrame:
    return stream.read_table(bank.spark, _run_stream(bank), "enriched").drop("props")


@register
def events_tiered(bank: Bank) -> DataFrame:
    events = bank.raw("events").withColumn("event_timestamp", F.col("ts").cast("timestamp"))
    path = scratch_path(bank.spark, "tiers")
    stream.write_tiers(events.drop("ts"), path, TIER_DAY)
    return bank.spark.read.parquet(path).groupBy("tier", "event_date").agg(
        F.count("*").alias("events")
    )


@register
def events_tier_moves(bank: Bank) -> DataFrame:
    """Tiers of one day, moved on to those of a later one."""
    events = bank.raw("events").withColumn("event_timestamp", F.col("ts").cast("timestamp"))
    path = scratch_path(bank.spark, "tiers")
    stream.write_tiers(events.drop("ts"), path, TIER_DAY)
    stream.move_tiers(bank.spark, path, NEXT_TIER_DAY)
    return bank.spark.read.parquet(path).groupBy("tier", "event_date").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("ids")
    )


# -- silver, lineage ------------------------------------------------------------------------


@register
def transactions_clean(bank: Bank) -> DataFrame:
    valid, _ = clean.clean_transactions(bank.transactions)
    return valid


@register
def transactions_rejected(bank: Bank) -> DataFrame:
    _, rejected = clean.clean_transactions(bank.transactions)
    return rejected


@register
def lineage_trace(bank: Bank) -> DataFrame:
    """Orders feed a customer's figure, customers a nation's, nations a region's."""

    def edges(child: str, child_key: str, parent: str, parent_key: str, df: DataFrame) -> DataFrame:
        return df.select(
            F.lit(child).alias("source_table"),
            F.col(child_key).cast("string").alias("source_column"),
            F.lit(parent).alias("target_table"),
            F.col(parent_key).cast("string").alias("target_column"),
        )

    all_edges = (
        edges("orders", "o_orderkey", "customer", "o_custkey", bank.raw("orders"))
        .unionByName(edges("customer", "c_custkey", "nation", "c_nationkey", bank.raw("customer")))
        .unionByName(edges("nation", "n_nationkey", "region", "n_regionkey", bank.raw("nation")))
    )
    return trace_upstream(all_edges, "region", "1")


# -- rules ----------------------------------------------------------------------------------


@register
def rule_savings_fee(bank: Bank) -> DataFrame:
    return rules.savings_fee(bank.snapshots, below=250_000)


@register
def rule_loan_interest(bank: Bank) -> DataFrame:
    loans = bank.accounts.withColumn("interest_rate", F.lit("0.05").cast("decimal(5,4)"))
    return rules.loan_interest(loans).withColumn(
        "monthly_interest", F.round("monthly_interest", 6)
    )


@register
def rule_active_not_verified(bank: Bank) -> DataFrame:
    return rules.active_not_verified(bank.accounts.withColumn("status", F.lit("ACTIVE")), bank.kyc)


@register
def rule_kyc_overdue(bank: Bank) -> DataFrame:
    return rules.kyc_overdue(bank.kyc, date(1995, 3, 1))


@register
def rule_rejected_with_txns(bank: Bank) -> DataFrame:
    return rules.rejected_with_txns(bank.transactions, bank.accounts, bank.kyc)


def _credit_scores(bank: Bank) -> DataFrame:
    points = (F.col("probability_of_default") * 1000).cast("int")
    return bank.scores.withColumn("credit_score", F.lit(850) - points)


@register
def rule_score_jumps(bank: Bank) -> DataFrame:
    return rules.score_jumps(_credit_scores(bank))


@register
def rule_risk_pd_corr(bank: Bank) -> DataFrame:
    return rules.risk_pd_corr(bank.kyc, bank.scores).withColumn(
        "correlation", F.round("correlation", 6)
    )


@register
def rule_balance_breaks(bank: Bank) -> DataFrame:
    return rules.balance_breaks(_snapshot_history(bank), consecutive_days=False)


@register
def rule_balance_breaks_days(bank: Bank) -> DataFrame:
    return rules.balance_breaks(_snapshot_history(bank))


@register
def rule_duplicate_customers(bank: Bank) -> DataFrame:
    return rules.duplicate_customers(bank.kyc, "nik")


@register
def rule_duplicate_groups(bank: Bank) -> DataFrame:
    """Customers that share a national id or a phone number, also through others."""
    c = F.col("customer_id")
    keyed = bank.kyc.select(
        "customer_id",
        F.when(c % 5 < 4, F.floor(c / 3).cast("string")).alias("nik"),
        F.when(c % 7 < 5, F.floor((c + 1) / 3).cast("string")).alias("phone"),
    )
    return rules.duplicate_groups(keyed)


@register
def rule_mask_pii(bank: Bank) -> DataFrame:
    return rules.mask_pii(bank.kyc).select("customer_id", "nik", "phone")


@register
def rule_sign_violations(bank: Bank) -> DataFrame:
    return rules.sign_violations(bank.transactions)


@register
def rule_score_features(bank: Bank) -> DataFrame:
    return rules.score_features(
        bank.raw("events").select("event_id", "props"), "k int", column="props"
    )


@register
def rule_feature_types(bank: Bank) -> DataFrame:
    """Keys and types of the JSON column; every thirteenth value is cut short and thus unreadable."""
    props = F.col("props")
    broken = F.when(F.col("event_id") % 13 == 0, F.substring(props, 1, 4)).otherwise(props)
    return rules.feature_types(bank.raw("events").select(broken.alias("props")), "props")
