"""Row numbers, connected groups, JSON keys without a schema, and the sweep that serves two rules."""

import random

import pytest
from pyspark.sql import functions as F

from bankflow.operators.groups import connected_groups
from bankflow.operators.ranking import with_row_number
from bankflow.operators.rolling import Lane, rolling_lanes, rolling_plain
from bankflow.operators.rules import duplicate_groups, feature_types
from bankflow.plans import fraud
from bankflow.session import scratch_path
from bankflow.sinks.staged import Staging
from tests.helpers import dec, plan_of, rows, ts


def test_row_numbers_span_ranges(spark):
    rnd = random.Random(1)
    values = [(i, rnd.choice([None, 1, 1, 2, rnd.randrange(50)])) for i in range(2000)]
    df = spark.createDataFrame(values, "id int, v int").repartition(6)
    got = with_row_number(df, [F.asc_nulls_last("v"), F.desc("id")], "n", partitions=5)
    want = sorted(values, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(*r, i) for i, r in enumerate(want, 1)]
    assert dict(got.dtypes)["n"] == "bigint"
    assert with_row_number(df.limit(0), [F.asc("v")]).count() == 0


def test_equal_rows_spread_over_ranges(spark):
    df = spark.range(4000).select(F.lit(7).alias("v"))
    ranked = with_row_number(df, [F.asc("v")], partitions=4)
    assert [r["row_number"] for r in ranked.orderBy("row_number").collect()] == list(range(1, 4001))
    assert len(set(ranked.inputFiles())) > 1


def brute_groups(customers):
    parent = {c: c for c, *_ in customers}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    first = {}
    for c, *keys in customers:
        for i, k in enumerate(keys):
            if k is not None and k.strip():
                a, b = sorted((find(c), find(first.setdefault((i, k.strip()), c))))
                parent[b] = a
    members = {}
    for c in parent:
        members.setdefault(find(c), []).append(c)
    return sorted((c, g) for g, m in members.items() if len(m) > 1 for c in m)


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    values = [
        (c, rnd.choice([None, "", str(rnd.randrange(120))]), rnd.choice([None, f" {rnd.randrange(150)}"]))
        for c in range(200)
    ]
    df = spark.createDataFrame(values, "customer_id int, nik string, phone string")
    assert rows(duplicate_groups(df)) == sorted(brute_groups(values), key=repr)


def test_long_chains_and_hubs(spark):
    chain = [(c, str(c // 2), str((c + 1) // 2)) for c in range(300)]
    hub = [(c, "hub", None) for c in range(1000, 1400)]
    df = spark.createDataFrame(chain + hub, "customer_id int, nik string, phone string")
    got = connected_groups(df, "customer_id", ["nik", "phone"])
    assert rows(got.groupBy("group_id").count()) == [(0, 300), (1000, 400)]
    assert connected_groups(df.limit(0), "customer_id", ["nik"]).count() == 0


def test_feature_types(spark):
    values = ['{"a": 1, "b": "x", "c": {"d": 1}}', '{"a": 1.5}', "[1,2]", "oops", None, "{}", "[]", "3", '{"a": null}']
    df = spark.createDataFrame([(v,) for v in values], "features_used string")
    assert set(rows(feature_types(df))) == {
        ("a", "BIGINT", 1), ("a", "DECIMAL(2,1)", 1), ("a", "VOID", 1), ("b", "STRING", 1),
        ("c", "OBJECT<d: BIGINT>", 1), (None, "ARRAY<BIGINT>", 1), (None, "ARRAY<VOID>", 1),
        (None, "BIGINT", 1), (None, "OBJECT<>", 1), (None, None, 2),
    }


@pytest.fixture(scope="module")
def bank(spark):
    rnd = random.Random(2)
    txns = []
    for i in range(400):
        minute = rnd.randrange(60 * 24 * 50)
        at = ts(f"2025-{1 + minute // 1440 // 25:02d}-{1 + minute // 1440 % 25:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00")
        txns.append((f"t{i}", f"a{rnd.randrange(4)}", at, dec(str(rnd.choice([-1, 1]) * rnd.choice([5, 10, 90]))), "COMPLETED"))
    folder = scratch_path(spark, "bank")
    spark.createDataFrame(
        txns, "txn_id string, account_id string, txn_date timestamp_ntz, amount decimal(15,2), status string"
    ).write.parquet(f"{folder}/transactions")
    spark.createDataFrame([(f"a{i}", f"c{i // 2}") for i in range(4)], "account_id string, customer_id string").write.parquet(f"{folder}/accounts")
    spark.createDataFrame([(t[0], rnd.choice(["Solo", "Medan", "Bali", None])) for t in txns[:350]], "txn_id string, merchant_city string").write.parquet(f"{folder}/locations")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("transactions", "accounts", "locations")}


@pytest.mark.parametrize("hot_rows", [1_000_000, 0])
def test_lanes_equal_one_frame_each(bank, hot_rows):
    rows_ = bank["transactions"].withColumn("customer_id", F.col("account_id"))
    lanes = [Lane("hour", 7200, total=False), Lane("before", 86400 * 9, exclude_current=True)]
    got = rolling_lanes(rows_, lanes, hot_rows=hot_rows).select("txn_id", "hour_rows", "before_rows", "before_sum")
    hour = rolling_plain(rows_, seconds=7200).select("txn_id", "window_rows")
    before = rolling_plain(rows_, seconds=86400 * 9, exclude_current=True)
    want = hour.join(before.select("txn_id", F.col("window_rows").alias("n"), "window_sum"), "txn_id")
    assert rows(got) == rows(want)


def test_fraud_reads_transactions_twice(spark, bank, monkeypatch):
    plans, plain = [], Staging.write
    monkeypatch.setattr(
        Staging, "write", lambda self, df, name, **f: (plans.append(plan_of(df)), plain(self, df, name, **f))[1]
    )
    thresholds = {"min_count": 2, "days": 5, "ratio": 2, "warmup_days": 1}
    got = fraud.fraud_alerts(*bank.values(), **thresholds)
    physical = [p.split("== Physical Plan ==")[1] for p in [*plans, plan_of(got)]]
    # The hot and the ordinary branch of the sweep share one scan of the joined rows' files.
    assert [p.count("/transactions]") > 0 for p in physical] == [True, True, False]
    assert rows(got) == rows(fraud.fraud_alerts_by_rule(*bank.values(), **thresholds))
    assert {r["alert_type"] for r in got.collect()} == {"HIGH_FREQUENCY_1H", "MULTI_CITY_1D", "HIGH_AMOUNT_30D"}
