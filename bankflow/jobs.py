"""Command line of the pipelines: ``spark-submit bankflow/jobs.py <job> ...`` or ``python -m``.

Tables come from a folder of CSV files with headers (``--source local``), from the session's catalog
(``--source catalog``), or from a database over JDBC (``--source jdbc``) with JDBC_URL, JDBC_USER and
JDBC_PASSWORD in the environment.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from bankflow import schemas
from bankflow.functions import parse_day, parse_month
from bankflow.operators.alerts import alert_counts, order_alerts
from bankflow.operators.clean import clean_transactions
from bankflow.operators.locations import assign_city
from bankflow.operators.quality import partition_counts
from bankflow.plans.account_snapshot import preview, run_account_snapshot
from bankflow.plans.fraud import fraud_alerts
from bankflow.plans.lineage import trace_upstream
from bankflow.plans.scorecard import scorecard, scorecard_month, scorecard_summary
from bankflow.session import build_session
from bankflow.sinks import export_csv, upsert
from bankflow.sinks.staged import Staging
from bankflow.sources import read_csv, read_jdbc, read_jdbc_window, read_snapshot_day, read_snapshots
from bankflow.sources.events import read_events_stream
from bankflow.sources.jdbc import JdbcPartition, JdbcTextSplit
from bankflow.streaming.clickstream import (
    ClickstreamPaths,
    move_tiers,
    recover_late_events,
    run_clickstream,
    start_clickstream,
    wait_for_all,
)

LAYOUTS = {
    "customers": schemas.CUSTOMERS,
    "accounts": schemas.ACCOUNTS,
    "transactions": schemas.TRANSACTIONS,
    "credit_scores": schemas.CREDIT_SCORES,
    "transaction_locations": schemas.TRANSACTION_LOCATIONS,
}


class Tables:
    """The bank's tables by name, from files or from a database."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def __call__(self, name: str) -> DataFrame:
        if self.args.source == "local":
            return read_csv(self.spark, f"{self.args.data_dir}/{name}.csv", LAYOUTS[name])
        if self.args.source == "catalog":
            return self.spark.table(".".join(filter(None, (self.args.database, name))))
        return read_jdbc(
            self.spark, table=name, partition=self.partition_of(name), **credentials()
        )

    def partition_of(self, name: str) -> JdbcPartition | JdbcTextSplit | None:
        """The split given for a table; transactions may not be read by one task."""
        for text in self.args.jdbc_split or ():
            table, column, *bounds = text.split(",")
            if table == name:
                return JdbcTextSplit(column, tuple(bounds))
        for text in self.args.jdbc_partition or ():
            table, column, lower, upper, count = text.split(",")
            if table == name:
                return JdbcPartition(column, lower, upper, int(count))
        if name == "transactions":
            raise ValueError("give --jdbc-partition transactions,<column>,<lower>,<upper>,<count>")
        return None

    def transactions_of(self, day: str) -> DataFrame:
        """One day of transactions; a database filters it at the source."""
        if self.args.source != "jdbc":
            return self("transactions")
        return read_jdbc_window(self.spark, table="transactions", day=day, **credentials())


def credentials() -> dict[str, str]:
    found = {key: os.environ.get(f"JDBC_{key.upper()}", "") for key in ("url", "user", "password")}
    missing = [f"JDBC_{key.upper()}" for key, value in found.items() if not value]
    if missing:
        raise ValueError(f"not set: {', '.join(missing)}")
    return found


def job_snapshot(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = Tables(spark, args)
    report = run_account_snapshot(
        tables("accounts"),
        tables.transactions_of(args.snapshot_date),
        args.snapshot_date,
        args.output_path,
        args.audit_path,
        lineage_path=args.lineage_path,
    )
    for check in report:
        print(f"{check['check']:24} {'PASS' if check['passed'] else 'FAIL'} {check['actual']}")
    preview(read_snapshot_day(spark, args.output_path, args.snapshot_date), 10).show(truncate=False)


def job_check_snapshot(spark: SparkSession, args: argparse.Namespace) -> None:
    snapshots = read_snapshots(spark, args.path)
    print(f"rows: {snapshots.count()}")
    for row in partition_counts(snapshots).orderBy("snapshot_date").toLocalIterator():
        print(*row)


def job_export_snapshot(spark: SparkSession, args: argparse.Namespace) -> None:
    export_csv(read_snapshot_day(spark, args.path, args.snapshot_date), args.output_path)


def job_clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Valid transactions and rejected ones with their reasons, into two folders."""
    raw = Tables(spark, args)("transactions")
    valid, rejected = clean_transactions(raw)
    valid.write.mode("overwrite").parquet(args.output_path)
    rejected.write.mode("overwrite").parquet(args.rejected_path)
    reasons = spark.read.parquet(args.rejected_path).groupBy("reason").count().orderBy("reason")
    for row in reasons.toLocalIterator():
        print(*row)


def job_lineage(spark: SparkSession, args: argparse.Namespace) -> None:
    """Every column that one column comes from, over the edges that runs have recorded."""
    edges = spark.read.parquet(args.edges).select(
        "source_table", "source_column", "target_table", "target_column"
    ).distinct()
    found = trace_upstream(edges, args.table, args.column)
    for row in found.orderBy("hop", "table_name", "column_name").toLocalIterator():
        print(row["hop"], f"{row['table_name']}.{row['column_name']}")


def job_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    """The clickstream: what has arrived, or with ``--every`` without end (or for ``--stop-after`` seconds)."""
    tables = Tables(spark, args)
    options = dict(o.split("=", 1) for o in args.option or ())
    raw = read_events_stream(spark, args.format, options, args.event_schema, args.input)

    def context() -> tuple[DataFrame, DataFrame]:
        snapshots = read_snapshots(spark, args.snapshots) if args.snapshots else tables("accounts")
        return tables("customers"), snapshots

    settings = {"delay": args.delay, "files_per_date": args.files_per_date}
    if args.every is None:
        run_clickstream(spark, raw, args.output_path, context, progress_path=args.progress_path, **settings)
        return
    queries = start_clickstream(
        spark, raw, args.output_path, context, trigger={"processingTime": args.every}, **settings
    )
    wait_for_all(spark, queries, args.stop_after)


def job_recover_late(spark: SparkSession, args: argparse.Namespace) -> None:
    """Append the events that came too late for the stream."""
    tables = Tables(spark, args)

    def context() -> tuple[DataFrame, DataFrame]:
        snapshots = read_snapshots(spark, args.snapshots) if args.snapshots else tables("accounts")
        return tables("customers"), snapshots

    print("recovered:", recover_late_events(spark, ClickstreamPaths(args.path), context))


def job_tiers(spark: SparkSession, args: argparse.Namespace) -> None:
    """Move tiered events whose age has crossed a limit."""
    for day, old, new in move_tiers(spark, args.path, parse_day(args.as_of)):
        print(day, old, "->", new)


def job_cities(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = Tables(spark, args)
    assign_city(
        tables("transactions"), tables("accounts"), tables("customers"), args.home_share
    ).write.mode("overwrite").option("header", True).csv(args.output_path)


def _scorecard_inputs(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, ...]:
    tables = Tables(spark, args)
    return (
        tables("customers"),
        read_snapshots(spark, args.snapshots),
        tables("accounts"),
        tables("transactions"),
        tables("credit_scores"),
    )


def job_scorecard(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = scorecard(*_scorecard_inputs(spark, args))
    rows.write.mode("overwrite").partitionBy("month_start").parquet(args.output_path)


def job_scorecard_month(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = scorecard_month(*_scorecard_inputs(spark, args), args.run_month)
    upsert(args.output_path, rows, ["month_start", "customer_id"], "month_start")
    summary = scorecard_summary(spark.read.parquet(args.output_path)).orderBy("month_start")
    for row in summary.toLocalIterator():
        print(*row)


def job_fraud(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = Tables(spark, args)
    staging = Staging(spark)
    alerts = fraud_alerts(
        tables("transactions"),
        tables("accounts"),
        read_csv(spark, args.locations, schemas.TRANSACTION_LOCATIONS),
        staging=staging,
    )
    order_alerts(alerts).write.mode("overwrite").parquet(args.output_path)
    staging.drop()
    alert_counts(spark.read.parquet(args.output_path)).show()


def _day(text: str) -> str:
    return str(parse_day(text))


def _month(text: str) -> str:
    return str(parse_month(text))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bankflow")
    jobs = top.add_subparsers(dest="job", required=True)

    def add(name: str, run, tables: bool = True) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        if tables:
            sub.add_argument("--source", choices=["local", "catalog", "jdbc"], default="local")
            sub.add_argument("--data-dir", default="data/raw")
            sub.add_argument("--database", help="schema of the catalog tables")
            sub.add_argument(
                "--jdbc-partition", action="append", metavar="TABLE,COLUMN,LOWER,UPPER,COUNT",
                help="parallel range read of a database table; this or a split is required for transactions",
            )
            sub.add_argument(
                "--jdbc-split", action="append", metavar="TABLE,COLUMN,VALUE[,VALUE...]",
                help="parallel read of a database table with a text key, cut at these values",
            )
        return sub

    sub = add("snapshot", job_snapshot)
    sub.add_argument("--snapshot-date", required=True, type=_day)
    sub.add_argument("--output-path", required=True)
    sub.add_argument("--audit-path")
    sub.add_argument("--lineage-path", help="table to which the run's column lineage is appended")

    sub = add("check-snapshot", job_check_snapshot, tables=False)
    sub.add_argument("--path", required=True)

    sub = add("export-snapshot", job_export_snapshot, tables=False)
    sub.add_argument("--path", required=True)
    sub.add_argument("--snapshot-date", required=True, type=_day)
    sub.add_argument("--output-path", required=True)

    sub = add("clean", job_clean)
    sub.add_argument("--output-path", required=True)
    sub.add_argument("--rejected-path", required=True)

    sub = add("lineage", job_lineage, tables=False)
    sub.add_argument("--edges", required=True, help="lineage table that runs append to")
    sub.add_argument("--table", required=True)
    sub.add_argument("--column", required=True)

    sub = add("stream", job_stream)
    sub.add_argument("--format", default="kafka", help="kafka, or a file format")
    sub.add_argument("--input", help="folder in which event files arrive")
    sub.add_argument("--option", action="append", metavar="KEY=VALUE", help="option of the source")
    sub.add_argument("--event-schema", default=schemas.APP_EVENTS)
    sub.add_argument("--snapshots", help="snapshot table; without it the accounts are joined")
    sub.add_argument("--output-path", required=True)
    sub.add_argument("--delay", default="10 minutes", help="how late an event may come")
    sub.add_argument("--files-per-date", type=int)
    sub.add_argument("--progress-path", help="table of rows read and dropped, for runs without --every")
    sub.add_argument("--every", help="go on without end in micro-batches this far apart")
    sub.add_argument("--stop-after", type=float, help="seconds after which an endless run stops")

    sub = add("recover-late", job_recover_late)
    sub.add_argument("--path", required=True, help="folder of the stream's tables")
    sub.add_argument("--snapshots", help="snapshot table; without it the accounts are joined")

    sub = add("tiers", job_tiers, tables=False)
    sub.add_argument("--path", required=True)
    sub.add_argument("--as-of", required=True, type=_day)

    sub = add("cities", job_cities)
    sub.add_argument("--home-share", type=int, default=95)
    sub.add_argument("--output-path", required=True)

    sub = add("scorecard", job_scorecard)
    sub.add_argument("--snapshots", required=True)
    sub.add_argument("--output-path", required=True)

    sub = add("scorecard-month", job_scorecard_month)
    sub.add_argument("--snapshots", required=True)
    sub.add_argument("--run-month", required=True, type=_month)
    sub.add_argument("--output-path", required=True)

    sub = add("fraud", job_fraud)
    sub.add_argument("--locations", required=True)
    sub.add_argument("--output-path", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or build_session(f"bankflow-{args.job}")
    try:
        args.run(session, args)
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    main()
