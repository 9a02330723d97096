import pytest

from bankflow.schemas import ACCOUNTS, APP_EVENTS, SNAPSHOTS, TRANSACTIONS, column_names
from bankflow.session import scratch_path
from bankflow.sources import read_csv
from bankflow.sources.events import parse_kafka
from bankflow.sources.jdbc import (
    JdbcPartition,
    JdbcTextSplit,
    hourly_day_partition,
    jdbc_options,
    window_of,
)
from tests.helpers import dec, plan_of


def test_csv_with_and_without_schema(spark):
    path = scratch_path(spark, "csv")
    text = spark.createDataFrame(
        [("account_id,customer_id,account_type,product_name,opened_date,status,balance,"
          "credit_limit,interest_rate",), ("a,c,LOAN,KTA,2025-01-02,ACTIVE,10.10,,0.0525",)],
        "value string",
    )
    text.coalesce(1).write.text(path)
    typed = read_csv(spark, path, ACCOUNTS)
    assert typed.columns == column_names(ACCOUNTS)
    row = typed.first()
    assert (row["balance"], row["credit_limit"], row["interest_rate"]) == (
        dec("10.10"), None, dec("0.0525"))
    inferred = dict(read_csv(spark, path).dtypes)
    assert inferred["opened_date"] == "date" and inferred["balance"] == "double"


def test_jdbc_options():
    split = JdbcPartition("txn_date", "2025-08-01 00:00:00", "2025-08-02 00:00:00", 24)
    assert hourly_day_partition("2025-08-01") == split
    options = jdbc_options("jdbc:x", "TRANSACTIONS", "u", "p", split)
    assert options == {
        "url": "jdbc:x", "dbtable": "TRANSACTIONS", "user": "u", "password": "p",
        "partitionColumn": "txn_date", "lowerBound": "2025-08-01 00:00:00",
        "upperBound": "2025-08-02 00:00:00", "numPartitions": "24",
    }
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "T", "u", "")


@pytest.mark.parametrize("bounds", [(), ("m",), ("d", "a'b", "t", "d")])
def test_text_splits_meet_every_row_once(spark, bounds):
    keys = [(k,) for k in ("", "a", "a'b", "b", "d", "m", "t", "z", None, None)]
    df = spark.createDataFrame(keys, "account_id string")
    parts = JdbcTextSplit("account_id", bounds).predicates()
    assert len(parts) == len(set(bounds)) + 1
    found = [r["account_id"] for p in parts for r in df.filter(p).collect()]
    assert sorted(map(str, found)) == sorted(str(k) for k, in keys)


def test_window_filters_and_columns_are_pushed(spark):
    path = scratch_path(spark, "txns")
    spark.createDataFrame([], TRANSACTIONS + ", extra string").write.parquet(path)
    plan = plan_of(window_of(spark.read.parquet(path), "2025-08-01"))
    assert "EqualTo(status,COMPLETED)" in plan and "GreaterThanOrEqual(txn_date" in plan
    assert "extra" not in plan.split("ReadSchema:")[1]


def test_kafka_values(spark):
    df = spark.createDataFrame(
        [('{"event_id": "e1", "event_timestamp": "2025-08-01T10:00:00", "device_type": "IOS"}',),
         ("no json",)],
        "value string",
    ).selectExpr("cast(value as binary) as value")
    parsed = parse_kafka(df)
    assert parsed.columns == [*column_names(APP_EVENTS), "kafka_value"]
    assert {bytes(r["kafka_value"]) for r in parsed.filter("event_id is null").collect()} == {b"no json"}
    got = {r["event_id"]: r["device_type"] for r in parsed.collect()}
    assert got == {"e1": "IOS", None: None}


def test_snapshot_layout():
    assert column_names(SNAPSHOTS)[0] == "snapshot_date" and len(column_names(SNAPSHOTS)) == 12


def test_csv_rejects_a_reordered_header_and_bad_values(spark):
    for lines in (["b,a", "1,x"], ["a,b", "x,12x"]):
        path = scratch_path(spark, "csv")
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
        with pytest.raises(Exception, match="CSV|header|MALFORMED|FAILED_READ"):
            read_csv(spark, path, "a string, b int").collect()
