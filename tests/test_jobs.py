"""The command line end to end on CSV files."""

import pytest

from bankflow import jobs
from bankflow.schemas import ALERTS, SCORECARD, column_names
from bankflow.session import scratch_path
from tests.helpers import d, dec, rows

FILES = {
    "customers": [
        "customer_id,full_name,nik,phone,email,city,province,registration_date,kyc_status,"
        "risk_score,segment",
        "c1,Ana,1,08,a@x,Solo,J,2024-01-01,VERIFIED,1.5,MASS",
        "c2,Budi,2,08,b@x,Medan,S,2024-01-01,PENDING,2.5,AFFLUENT",
    ],
    "accounts": [
        "account_id,customer_id,account_type,product_name,opened_date,status,balance,credit_limit,"
        "interest_rate",
        "a1,c1,SAVINGS,Plus,2024-01-01,ACTIVE,100.10,,0.01",
        "a2,c1,CREDIT_CARD,Gold,2024-01-01,ACTIVE,90,100,0.2",
        "a3,c2,LOAN,KTA,2024-01-01,ACTIVE,5,,0.1",
    ],
    "transactions": [
        "txn_id,account_id,txn_date,txn_type,amount,merchant_category,channel,reference_id,status",
        *[f"t{m},a1,2025-08-01 10:0{m}:00,DEBIT,-10.5,Groceries,QRIS,r,COMPLETED"
          for m in range(5)],
        "t9,a1,2025-08-01 12:00:00,DEBIT,-10.5,,QRIS,r,FAILED",
    ],
    "credit_scores": [
        "score_id,customer_id,score_date,model_version,credit_score,probability_of_default,"
        "features_used",
        's1,c2,2025-07-01,v2.1,600,0.35,"{""k"": 1}"',
    ],
}


def test_pipelines_on_csv(spark, capsys):
    folder = scratch_path(spark, "jobs")
    data = f"{folder}/raw"
    for name, lines in FILES.items():
        text = spark.createDataFrame([("\n".join(lines),)], "value string")
        text.coalesce(1).write.text(f"{data}/{name}.csv")

    def run(job, **options):
        argv = [job]
        for key, value in options.items():
            argv += [f"--{key.replace('_', '-')}", value]
        jobs.main(argv, spark)

    snapshots = f"{folder}/snapshots"
    run("snapshot", data_dir=data, snapshot_date="2025-08-01", output_path=snapshots,
        audit_path=f"{folder}/audit")
    run("check-snapshot", path=snapshots)
    assert "rows: 3" in capsys.readouterr().out
    table = spark.read.parquet(snapshots)
    assert rows(table, "account_id", "daily_net_amount", "daily_txn_count") == [
        ("a1", dec("-52.50"), 5), ("a2", dec("0.00"), 0), ("a3", dec("0.00"), 0),
    ]
    run("export-snapshot", path=snapshots, snapshot_date="2025-08-01",
        output_path=f"{folder}/export")
    assert spark.read.option("header", True).csv(f"{folder}/export").count() == 3

    run("cities", data_dir=data, output_path=f"{folder}/cities")
    assert spark.read.option("header", True).csv(f"{folder}/cities").count() == 5
    run("fraud", data_dir=data, locations=f"{folder}/cities", output_path=f"{folder}/alerts")
    alerts = spark.read.parquet(f"{folder}/alerts")
    assert alerts.columns == column_names(ALERTS)
    assert rows(alerts, "customer_id", "alert_type", "alert_date") == [
        ("c1", "HIGH_FREQUENCY_1H", d("2025-08-01"))
    ]

    run("scorecard", data_dir=data, snapshots=snapshots, output_path=f"{folder}/full")
    full = spark.read.parquet(f"{folder}/full")
    assert rows(full, "customer_id", "total_balance", "credit_utilization", "risk_flag") == [
        ("c1", dec("190.10"), dec("0.900000"), True), ("c2", dec("5.00"), dec("0E-6"), True),
    ]
    for _ in range(2):
        run("scorecard-month", data_dir=data, snapshots=snapshots, run_month="2025-08-01",
            output_path=f"{folder}/gold")
    gold = spark.read.parquet(f"{folder}/gold")
    for name in FILES:
        jobs.read_csv(spark, f"{data}/{name}.csv", jobs.LAYOUTS[name]).createOrReplaceTempView(name)
    run("scorecard", source="catalog", snapshots=snapshots, output_path=f"{folder}/full2")
    assert rows(spark.read.parquet(f"{folder}/full2")) == rows(full)
    assert gold.count() == 2 and set(gold.columns) == set(column_names(SCORECARD))
    assert dict(gold.dtypes)["total_balance"] == "decimal(20,2)"


def write_lines(spark, path, lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def test_clean_and_lineage_jobs(spark, capsys):
    folder = scratch_path(spark, "jobs")
    for name in ("accounts", "transactions"):
        write_lines(spark, f"{folder}/raw/{name}.csv", FILES[name])
    bad = FILES["transactions"][:2] + ["t0,a1,2025-08-01 09:00:00,DANCE,-1,,QRIS,r,COMPLETED"]
    write_lines(spark, f"{folder}/more/transactions.csv", bad)
    jobs.main(["clean", "--data-dir", f"{folder}/more", "--output-path", f"{folder}/valid",
               "--rejected-path", f"{folder}/rejected"], spark)
    assert capsys.readouterr().out == "txn_type is unknown 1\n"
    assert rows(spark.read.parquet(f"{folder}/valid"), "txn_id") == [("t0",)]

    jobs.main(["snapshot", "--data-dir", f"{folder}/raw", "--snapshot-date", "2025-08-01",
               "--output-path", f"{folder}/snapshots", "--lineage-path", f"{folder}/lineage"], spark)
    capsys.readouterr()
    jobs.main(["lineage", "--edges", f"{folder}/lineage", "--table", "account_snapshots",
               "--column", "daily_txn_count"], spark)
    assert capsys.readouterr().out.splitlines() == [
        f"1 transactions.{c}" for c in ("account_id", "status", "txn_date", "txn_id")
    ]
    edges = spark.read.parquet(f"{folder}/lineage")
    assert rows(edges.filter("target_column = 'balance'"), "source_table", "source_column") == [
        ("accounts", "balance")
    ]
    assert edges.select("run_id").distinct().count() == 1


EVENTS = [
    "e1,c1,2025-08-01 10:00:00,login,Dashboard,s1,IOS,1.0",
    "e1,c1,2025-08-01 10:00:00,login,Dashboard,s1,IOS,1.0",
    "e2,c9,2025-08-01 10:01:00,logout,Profile,s2,WEB,1.0",
    "e3,c1,2025-08-01 10:02:00,dance,Profile,s2,WEB,1.0",
]


@pytest.mark.parametrize("endless", [False, True])
def test_stream_job(spark, endless):
    folder = scratch_path(spark, "jobs")
    for name in ("customers", "accounts"):
        write_lines(spark, f"{folder}/raw/{name}.csv", FILES[name])
    write_lines(spark, f"{folder}/events", EVENTS)
    argv = ["stream", "--format", "csv", "--input", f"{folder}/events", "--data-dir", f"{folder}/raw",
            "--output-path", f"{folder}/tables"]
    # Side by side, bronze files arrive while the second query runs already.
    argv += ["--every", "1 second", "--stop-after", "25"] if endless else ["--progress-path", f"{folder}/p"]
    jobs.main(argv, spark)
    enriched = spark.read.parquet(f"{folder}/tables/enriched")
    assert rows(enriched, "event_id", "segment", "account_count") == [("e1", "MASS", 2), ("e2", None, None)]
    assert rows(spark.read.parquet(f"{folder}/tables/quarantine"), "event_id") == [("e3",)]
    jobs.main(["recover-late", "--path", f"{folder}/tables", "--data-dir", f"{folder}/raw"], spark)
    assert spark.read.parquet(f"{folder}/tables/silver").count() == 2
    if not endless:
        progress = spark.read.parquet(f"{folder}/p")
        assert rows(progress.groupBy("run_id").sum("input_rows", "dropped_by_watermark"))[0][1:] == (8, 0)


def test_arguments(monkeypatch):
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(["snapshot", "--snapshot-date", "1/8/2025", "--output-path", "x"])
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(
            ["scorecard-month", "--snapshots", "s", "--run-month", "2025-08-02",
             "--output-path", "x"]
        )
    for key in ("JDBC_URL", "JDBC_USER", "JDBC_PASSWORD"):
        monkeypatch.delenv(key, raising=False)
    with pytest.raises(ValueError, match="JDBC_URL"):
        jobs.credentials()


def test_database_tables_are_read_in_parallel():
    split = "transactions,txn_date,2025-08-01,2025-09-01,12"
    args = jobs.parser().parse_args(["fraud", "--source", "jdbc", "--locations", "l", "--output-path", "o",
                                     "--jdbc-partition", split])
    found = jobs.Tables(None, args).partition_of("transactions")
    assert (found.column, found.lower, found.upper, found.count) == (
        "txn_date", "2025-08-01", "2025-09-01", 12)
    assert jobs.Tables(None, args).partition_of("accounts") is None
    args.jdbc_split = ["accounts,account_id,ACC2000,ACC4000"]
    assert jobs.Tables(None, args).partition_of("accounts").bounds == ("ACC2000", "ACC4000")
    args.jdbc_partition = None
    with pytest.raises(ValueError, match="--jdbc-partition"):
        jobs.Tables(None, args).partition_of("transactions")
