"""Banking tables derived from the test tables, as SQL both engines run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from bankflow.sinks.staged import Staging

TABLES = ("nation", "customer", "orders", "lineitem", "events")

FIXTURES = {
    "fx_customers": """
select c.c_custkey as customer_id, c.c_name as full_name, n.n_name as city,
       c.c_mktsegment as segment
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey""",
    "fx_snapshots": """
select snapshot_date, account_id, customer_id, account_type, balance, credit_limit from (
  select cast(o_orderdate as date) as snapshot_date,
    concat(cast(o_custkey as string), '-', substr(o_orderpriority, 1, 1)) as account_id,
    o_custkey as customer_id,
    case substr(o_orderpriority, 1, 1) when '1' then 'CREDIT_CARD' when '2' then 'LOAN'
      when '3' then 'INVESTMENT' else 'SAVINGS' end as account_type,
    cast(o_totalprice as decimal(15,2)) as balance,
    case when substr(o_orderpriority, 1, 1) = '1' then cast(400000 as decimal(15,2)) end
      as credit_limit,
    row_number() over (partition by o_custkey, o_orderpriority, cast(o_orderdate as date)
      order by o_orderkey desc) as rn
  from {orders}) s
where rn = 1""",
    "fx_accounts": """
select account_id, customer_id, account_type, balance, credit_limit from (
  select s.*, row_number() over (partition by account_id order by snapshot_date desc) as rn
  from {fx_snapshots} s) a
where rn = 1""",
    "fx_transactions": """
select concat(cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string)) as txn_id,
  concat(cast(o.o_custkey as string), '-', substr(o.o_orderpriority, 1, 1)) as account_id,
  l.l_shipdate as txn_date,
  case l.l_suppkey % 6 when 0 then 'DEBIT' when 1 then 'CREDIT' when 2 then 'TRANSFER_IN'
    when 3 then 'TRANSFER_OUT' when 4 then 'PAYMENT' else 'FEE' end as txn_type,
  case when l.l_suppkey % 6 in (1, 2) then cast(l.l_extendedprice as decimal(15,2))
    else -cast(l.l_extendedprice as decimal(15,2)) end as amount,
  case l.l_linenumber when 1 then 'MOBILE_APP' when 2 then 'WEB' when 3 then 'QRIS'
    when 4 then 'ATM_NETWORK' when 5 then 'AUTO_DEBIT' end as channel,
  case l.l_linestatus when 'F' then 'COMPLETED' else 'PENDING' end as status
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "fx_scores": """
select customer_id, score_date, max(probability_of_default) as probability_of_default from (
  select o.o_custkey as customer_id, cast(l.l_shipdate as date) as score_date,
    cast(l.l_discount * 5 as decimal(5,4)) as probability_of_default
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey) s
group by customer_id, score_date""",
    "fx_txn_events": """
select event_id as txn_id, user_id as account_id, ts as txn_date,
  cast(value as decimal(15,2)) as amount, event_type as merchant_category,
  case event_type when 'error' then 'FAILED' else 'COMPLETED' end as status
from {events}""",
    "fx_event_accounts": """
select c_custkey as account_id, c_custkey as customer_id from {customer}""",
    "fx_kyc": """
select c_custkey as customer_id,
  case when c_custkey % 10 < 7 then 'VERIFIED' when c_custkey % 10 < 9 then 'PENDING'
    else 'REJECTED' end as kyc_status,
  date '1995-01-01' + cast(c_custkey % 60 as int) as registration_date,
  cast(abs(c_acctbal) / 100 as decimal(9,4)) as risk_score,
  lpad(cast(c_custkey % 140 as string), 16, '0') as nik,
  concat('08', lpad(cast(c_custkey as string), 9, '0')) as phone
from {customer}""",
}


def ensure_shared_folder(spark: SparkSession) -> None:
    """Give a local session a checkpoint folder when none is set; a cluster must name its own."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
    if unset and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bankflow-checkpoint-"))


class Bank:
    """The derived tables as DataFrames of one session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_shared_folder(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            self._raw[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._raw[table]

    def __getattr__(self, name: str) -> DataFrame:
        text = FIXTURES.get(f"fx_{name}")
        if text is None:
            raise AttributeError(name)
        inputs = {t: self.raw(t) for t in TABLES if f"{{{t}}}" in text}
        if "{fx_snapshots}" in text:
            inputs["fx_snapshots"] = self.snapshots
        built = self.spark.sql(text, **inputs)
        setattr(self, name, built)
        return built

    def store(self, *names: str) -> None:
        """Write derived tables to the shared folder and read them from there, for queries of several loads."""
        staging = Staging(self.spark)
        for name in names:
            setattr(self, name, staging.write(getattr(self, name), f"fx-{name}"))


def with_fixtures(query: str, *names: str) -> str:
    """The query behind the CTEs of the named fixtures, for the checking engine."""
    plain = {t: t for t in TABLES} | {f: f for f in FIXTURES}
    wanted = list(names)
    if "fx_accounts" in wanted and "fx_snapshots" not in wanted:
        wanted.insert(0, "fx_snapshots")
    wanted.sort(key=list(FIXTURES).index)
    ctes = [f"{name} as ({FIXTURES[name].format(**plain)})" for name in wanted]
    body = query.strip()
    if body.lower().startswith("with recursive "):
        raise ValueError("put recursive parts into the query without fixtures")
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
