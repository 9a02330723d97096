"""Every registered query against its SQL on the smallest tables, and its plan."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from parity import oracle
from parity.queries import QUERIES
from tests.helpers import plan_of

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()
WRITERS = {
    "snapshot_rerun", "snapshot_day_scan", "snapshot_export", "run_audit", "scorecard_upsert",
    "events_clean", "events_quarantine", "events_enriched", "events_tiered", "lineage_trace",
    "lineage_of_run", "events_late", "events_tier_moves", "rule_duplicate_groups", "dq_report",
}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(
        repr(r) for r in db.execute(f"select {quoted} from ({SQL[name]}) q").fetchall()
    )
    assert got == want and got


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITERS])
def test_no_cross_joins_and_no_python_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
        assert word not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 12_000
