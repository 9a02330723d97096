"""SQL of the checking engine for the registered queries."""

from __future__ import annotations

from parity.fixtures import with_fixtures

DAY_ROWS = """
daily as (
  select account_id, sum(amount) as daily_net_amount, count(txn_id) as daily_txn_count
  from fx_transactions
  where status = 'COMPLETED' and txn_date >= date '{day}' and txn_date < date '{day}' + 1
  group by account_id)"""


def _snapshot(day: str) -> str:
    return f"""
select a.account_id, a.customer_id, a.account_type, cast(a.balance as double) as balance,
  cast(a.credit_limit as double) as credit_limit,
  cast(coalesce(d.daily_net_amount, 0) as double) as daily_net_amount,
  cast(coalesce(d.daily_txn_count, 0) as bigint) as daily_txn_count,
  date '{day}' as snapshot_date
from fx_accounts a left join ({DAY_ROWS.format(day=day).strip()[len('daily as ('):-1]}) d
  on a.account_id = d.account_id"""


DAY = "1998-03-02"
SNAPSHOT_FX = ("fx_snapshots", "fx_accounts", "fx_transactions")

MONTHS = """
months as (select distinct cast(date_trunc('month', snapshot_date) as date) as month_start
  from fx_snapshots)"""

LATEST = """
latest as (select * from (
  select cast(date_trunc('month', snapshot_date) as date) as month_start, snapshot_date,
    account_id, customer_id, account_type, balance, credit_limit,
    row_number() over (partition by account_id, date_trunc('month', snapshot_date)
      order by snapshot_date desc) as rn
  from fx_snapshots) s where rn = 1)"""

BALANCE = """
balance as (select month_start, customer_id, sum(balance) as total_balance,
    sum(case when account_type = 'CREDIT_CARD' then balance else 0 end) as credit_card_balance,
    sum(case when account_type = 'CREDIT_CARD' then coalesce(credit_limit, 0) else 0 end)
      as total_credit_limit
  from latest group by month_start, customer_id)"""

TYPES = ("DEBIT", "CREDIT", "TRANSFER_IN", "TRANSFER_OUT", "PAYMENT", "FEE")
CHANNELS = ("MOBILE_APP", "WEB", "QRIS", "ATM_NETWORK", "AUTO_DEBIT")

ACTIVITY = (
    """
activity as (select cast(date_trunc('month', t.txn_date) as date) as month_start, a.customer_id,
"""
    + ",\n".join(
        f"    count(*) filter (where t.txn_type = '{t}') as {t.lower()}_count" for t in TYPES
    )
    + ",\n"
    + ",\n".join(
        f"    sum(abs(t.amount)) filter (where t.channel = '{c}') as sum_{c.lower()},\n"
        f"    count(*) filter (where t.channel = '{c}') as rows_{c.lower()}"
        for c in CHANNELS
    )
    + """
  from fx_transactions t join fx_accounts a on t.account_id = a.account_id
  where t.status = 'COMPLETED'
  group by 1, 2)"""
)

SCORED = """
scored as (select month_start, customer_id, score_date, probability_of_default from (
  select m.month_start, s.customer_id, s.score_date, s.probability_of_default,
    row_number() over (partition by m.month_start, s.customer_id order by s.score_date desc) as rn
  from fx_scores s join months m on s.score_date < m.month_start + interval '1 month') x
  where rn = 1)"""

GRID = """
grid as (select m.month_start, c.customer_id from fx_customers c cross join months m)"""


def _plain_time(column: str) -> str:
    """A time as text without zeros at the end of the second's fraction."""
    return f"regexp_replace(cast({column} as varchar), '[.]?0*$', '')" if column == "ts" else (
        f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    )


def _cents(column: str) -> str:
    return f"cast(cast({column} as decimal(20,2)) * 100 as hugeint)"


def _rounded(numerator: str, denominator: str, scale: int) -> str:
    """Quotient of two integers rounded half away from zero, without floating point."""
    unit = 10**scale
    return (
        f"(case when ({numerator}) < 0 then -1 else 1 end * "
        f"((2 * abs({numerator}) * {unit} + abs({denominator})) // (2 * abs({denominator})))) "
        f"/ {unit}.0"
    )


def _mean(channel: str) -> str:
    rows = f"rows_{channel}"
    mean = _rounded(_cents(f"sum_{channel}"), f"cast({rows} as hugeint)", 0)
    return f"case when {rows} > 0 then ({mean}) / 100.0 end as avg_{channel}_amount"


def _change(scale: int) -> str:
    diff = _cents("total_balance - previous_month_balance")
    ratio = _rounded(diff, _cents("previous_month_balance"), scale)
    return f"case when previous_month_balance <> 0 then {ratio} end as mom_balance_change_pct"


def _used(scale: int) -> str:
    ratio = _rounded(_cents("credit_card_balance"), _cents("total_credit_limit"), scale)
    return f"case when total_credit_limit > 0 then {ratio} else 0.0 end as credit_utilization"


FLAG = """coalesce(total_credit_limit > 0 and credit_card_balance > 0.80 * total_credit_limit, false)
  or coalesce(probability_of_default > 0.30, false)
  or coalesce(previous_month_balance <> 0 and
    total_balance - previous_month_balance < -0.30 * abs(previous_month_balance), false)"""

_COUNTS = [f"{t.lower()}_count" for t in TYPES]
_NAMES = [c.lower() for c in CHANNELS]

FACTS = f"""
facts as (select g.month_start, g.customer_id,
    coalesce(b.total_balance, 0) as total_balance, b.credit_card_balance, b.total_credit_limit,
    {", ".join(f"coalesce(x.{c}, 0) as {c}" for c in _COUNTS)},
    {", ".join(f"x.sum_{c}, x.rows_{c}" for c in _NAMES)},
    s.probability_of_default
  from grid g
  left join balance b on g.customer_id = b.customer_id and g.month_start = b.month_start
  left join activity x on g.customer_id = x.customer_id and g.month_start = x.month_start
  left join scored s on g.customer_id = s.customer_id and g.month_start = s.month_start),
final as (select *, lag(total_balance) over (partition by customer_id order by month_start)
    as previous_month_balance from facts)"""


def _card_columns(change_scale: int, used_scale: int) -> str:
    return f"""month_start, customer_id, cast(total_balance as double) as total_balance,
  cast(previous_month_balance as double) as previous_month_balance,
  cast(total_balance - previous_month_balance as double) as mom_balance_change,
  {_change(change_scale)},
  {_used(used_scale)},
  cast(probability_of_default as double) as probability_of_default,
  {", ".join(f"cast({c} as bigint) as {c}" for c in _COUNTS)},
  {", ".join(_mean(c) for c in _NAMES)},
  {FLAG} as risk_flag"""


CARD_FX = ("fx_customers", "fx_snapshots", "fx_accounts", "fx_transactions", "fx_scores")
CARD_CTES = ",".join((MONTHS, LATEST, BALANCE, ACTIVITY, SCORED, GRID, FACTS))
CARD = f"with {CARD_CTES.strip()}\n"


def _months_of(run_month: str) -> str:
    """The month list of an incremental load: the run month and the one before."""
    return MONTHS[:-1] + (
        f"\n  where snapshot_date >= date '{run_month}' - interval '1 month'"
        f" and snapshot_date < date '{run_month}' + interval '1 month')"
    )


def _month_card(run_month: str) -> str:
    ctes = ",".join((_months_of(run_month), LATEST, BALANCE, ACTIVITY, SCORED, GRID, FACTS))
    return (
        f"with {ctes.strip()}\nselect {_card_columns(6, 6)}\nfrom final "
        f"where month_start = date '{run_month}'"
    )


EVENT_FX = ("fx_txn_events", "fx_event_accounts")

EVENT_ROWS = """
done as (select a.customer_id, t.txn_id, t.txn_date, abs(t.amount) as amount
  from fx_txn_events t join fx_event_accounts a on t.account_id = a.account_id
  where t.status = 'COMPLETED')"""

RATE = """
rate as (select *, count(*) over (partition by customer_id order by txn_date
    range between interval 3600 second preceding and current row) as txn_count
  from done)"""

MEANS = """
means as (select *, count(*) over w as window_rows, sum(amount) over w as window_sum from done
  window w as (partition by customer_id order by txn_date
    range between interval 7 day preceding and interval 1 microsecond preceding))"""

CITIES = """
cities as (select city, row_number() over (order by city) - 1 as city_index
  from (select distinct city from fx_customers where city <> '') c),
homes as (select a.account_id, x.city_index as home_index
  from fx_event_accounts a join fx_customers c on a.customer_id = c.customer_id
  join cities x on c.city = x.city),
hashed as (select t.txn_id, h.home_index, (select count(*) from cities) as n,
    cast(('0x' || substr(md5(cast(t.txn_id as varchar)), 1, 8)) as bigint) as h
  from fx_txn_events t join homes h on t.account_id = h.account_id
  where t.merchant_category <> ''),
picked as (select *, (h // 100) % (n - 1) as other from hashed)"""


def _places(home_share: int) -> str:
    return f"""
places as (select p.txn_id, c.city as merchant_city, 'SYNTHETIC_TEST' as location_source
  from picked p join cities c on c.city_index = case when p.h % 100 < {home_share}
    then p.home_index else p.other + case when p.other >= p.home_index then 1 else 0 end end)"""


HIGH_FREQUENCY = """
frequent as (select customer_id, cast(txn_date as date) as alert_date,
    max(txn_count) as max_transactions, min(txn_date) as first_trigger_at
  from rate where txn_count >= 3 group by 1, 2)"""

MULTI_CITY = """
spread as (select a.customer_id, cast(t.txn_date as date) as alert_date,
    count(distinct p.merchant_city) as city_count,
    string_agg(distinct p.merchant_city, ',' order by p.merchant_city) as cities
  from fx_txn_events t join fx_event_accounts a on t.account_id = a.account_id
  join places p on t.txn_id = p.txn_id
  where t.status = 'COMPLETED' group by 1, 2 having count(distinct p.merchant_city) >= 3)"""

HIGH_AMOUNT = f"""
high as (select customer_id, cast(txn_date as date) as alert_date, txn_id, txn_date, amount,
    window_rows, window_sum,
    ({_rounded(_cents("window_sum"), "cast(window_rows as hugeint)", 0)}) / 100.0 as avg_amount,
    {_rounded("cast(window_rows as hugeint) * " + _cents("amount"), _cents("window_sum"), 2)}
      as ratio_to_avg
  from means
  where window_rows > 0 and amount * window_rows > 3 * window_sum
    and txn_date >= (select min(txn_date) + interval 7 day from fx_txn_events
      where status = 'COMPLETED'))"""

FRAUD_CTES = ",".join(
    (EVENT_ROWS, RATE, MEANS, CITIES, _places(50), HIGH_FREQUENCY, MULTI_CITY, HIGH_AMOUNT)
)
FRAUD_FX = ("fx_customers", *EVENT_FX)
ALERTS = """
alerts as (
  select customer_id, 'HIGH_FREQUENCY_1H' as alert_type, alert_date,
    cast(max_transactions as bigint) as max_transactions_in_1h, cast(null as bigint) as city_count,
    cast(null as varchar) as cities, cast(null as bigint) as txn_id,
    cast(null as double) as amount, cast(null as double) as avg_amount_30d,
    cast(null as double) as ratio_to_avg from frequent
  union all
  select customer_id, 'MULTI_CITY_1D', alert_date, null, city_count, cities, null, null, null, null
  from spread
  union all
  select customer_id, 'HIGH_AMOUNT_30D', alert_date, null, null, null, txn_id,
    cast(amount as double), avg_amount, ratio_to_avg from high)"""

GOOD_EVENT = "event_type in ('view', 'click', 'signup', 'purchase')"
GOOD_TXN = (
    "txn_id is not null and account_id is not null and txn_date is not null "
    "and amount is not null and txn_type is not null and channel is not null "
    "and status is not null"
)
TXN_COLUMNS = (
    "txn_id, account_id, epoch_us(txn_date) as txn_date, txn_type, "
    "cast(amount as double) as amount, channel, status"
)


def oracle_sql() -> dict[str, str]:
    fx = with_fixtures
    day = _snapshot(DAY)
    snapshot_columns = (
        "snapshot_date, account_id, customer_id, account_type, balance, credit_limit, "
        "daily_net_amount, daily_txn_count"
    )
    sql: dict[str, str] = {}

    sql["account_snapshot_day"] = fx(day, *SNAPSHOT_FX)
    sql["daily_activity"] = fx(
        """select account_id, cast(sum(amount) as double) as daily_net_amount,
  count(txn_id) as daily_txn_count
from fx_transactions where status = 'COMPLETED' group by account_id""",
        "fx_transactions",
    )
    sql["dq_report"] = fx(
        f"""with day_rows as (select * from fx_transactions where status = 'COMPLETED'
  and txn_date >= date '{DAY}' and txn_date < date '{DAY}' + 1),
snapshot as ({day}),
n as (select (select count(*) from fx_accounts) as accounts,
  (select count(*) from snapshot) as snapshot_rows,
  (select count(distinct account_id) from snapshot) as ids,
  (select count(*) from snapshot where account_id is null) as nulls,
  (select coalesce(sum(amount), 0) from day_rows) as txn_total,
  (select coalesce(sum(t), 0) from (select sum(amount) as t from day_rows group by account_id) s)
    as summary_total,
  (select count(*) from day_rows d where not exists
    (select 1 from fx_accounts a where a.account_id = d.account_id)) as orphans)
select 'row_count' as "check", cast(accounts as double) as expected,
  cast(snapshot_rows as double) as actual, true as required, accounts = snapshot_rows as passed
from n union all
select 'null_account_id', 0, nulls, true, nulls = 0 from n union all
select 'unique_account_id', snapshot_rows, ids, true, snapshot_rows = ids from n union all
select 'amount_reconciliation', txn_total, summary_total, true, txn_total = summary_total from n
union all
select 'orphan_transactions', 0, orphans, false, orphans = 0 from n""",
        *SNAPSHOT_FX,
    )
    sql["partition_counts"] = fx(
        "select snapshot_date, count(*) as row_count from fx_snapshots group by snapshot_date",
        "fx_snapshots",
    )
    sql["orphan_transactions"] = fx(
        """select account_id, count(*) as orphan_rows, cast(sum(amount) as double) as orphan_amount
from fx_transactions t where not exists (select 1 from fx_accounts a
  where a.account_type <> 'LOAN' and a.account_id = t.account_id)
group by account_id""",
        *SNAPSHOT_FX,
    )
    both_days = f"select {snapshot_columns} from ({day}) d"
    sql["snapshot_day_scan"] = fx(both_days, *SNAPSHOT_FX)
    sql["snapshot_export"] = fx(both_days, *SNAPSHOT_FX)
    sql["snapshot_rerun"] = fx(
        f"{both_days} union all select {snapshot_columns} from ({_snapshot('1998-03-03')}) e",
        *SNAPSHOT_FX,
    )
    sql["run_audit"] = fx(
        f"""select 'account_snapshot' as pipeline_name, date '{DAY}' as snapshot_date,
  'accounts + transactions' as source, count(*) as row_count, 'PASS' as dq_status,
  'SUCCESS' as job_status from fx_accounts""",
        *SNAPSHOT_FX,
    )

    made_from = " union all ".join(
        f"select 'transactions' as table_name, '{c}' as column_name, 1 as hop"
        for c in ("amount", "account_id", "txn_date", "status")
    )
    sql["lineage_of_run"] = f"""{made_from} union all
select 'orders', cast(o_orderkey as varchar), 2 from orders"""

    sql["latest_snapshot_per_month"] = fx(
        f"""with {LATEST.strip()}
select month_start, snapshot_date, account_id, customer_id, account_type,
  cast(balance as double) as balance, cast(credit_limit as double) as credit_limit from latest""",
        "fx_snapshots",
    )
    sql["customer_month_balance"] = fx(
        f"""with {(LATEST + "," + BALANCE).strip()}
select month_start, customer_id, cast(total_balance as double) as total_balance,
  cast(credit_card_balance as double) as credit_card_balance,
  cast(total_credit_limit as double) as total_credit_limit from balance""",
        "fx_snapshots",
    )
    counts = f"""with {ACTIVITY.strip()}
select month_start, customer_id, {", ".join(_COUNTS)} from activity"""
    sql["txn_type_counts"] = fx(counts, *SNAPSHOT_FX)
    sql["txn_type_counts_filter"] = fx(counts, *SNAPSHOT_FX)
    sums = ", ".join(f"cast(sum_{c} as double) as sum_{c}, rows_{c}" for c in _NAMES)
    sql["channel_amount_sums"] = fx(
        f"with {ACTIVITY.strip()}\nselect month_start, customer_id, {sums} from activity",
        *SNAPSHOT_FX,
    )
    quotients = ", ".join(
        f"case when rows_{c} > 0 then round(cast(sum_{c} as double) / rows_{c}, 6) end "
        f"as avg_{c}_amount"
        for c in _NAMES
    )
    sql["channel_avg_amount"] = fx(
        f"with {ACTIVITY.strip()}\nselect month_start, customer_id, {quotients} from activity",
        *SNAPSHOT_FX,
    )
    means = ", ".join(_mean(c) for c in _NAMES)
    sql["channel_avg_amount_filter"] = fx(
        f"with {ACTIVITY.strip()}\nselect month_start, customer_id, {means} from activity",
        *SNAPSHOT_FX,
    )
    sql["report_months"] = fx(f"with {MONTHS.strip()} select * from months", "fx_snapshots")
    sql["customer_month_scaffold"] = fx(
        f"with {(MONTHS + ',' + GRID).strip()} select * from grid", "fx_customers", "fx_snapshots"
    )
    sql["scores_before_month"] = fx(
        f"""with {MONTHS.strip()}
select m.month_start, s.customer_id, s.score_date,
  cast(s.probability_of_default as double) as probability_of_default
from fx_scores s join months m on s.score_date < m.month_start + interval '1 month'""",
        "fx_snapshots",
        "fx_scores",
    )
    asof = fx(
        f"""with {(MONTHS + "," + SCORED).strip()}
select month_start, customer_id, score_date,
  cast(probability_of_default as double) as probability_of_default from scored""",
        "fx_snapshots",
        "fx_scores",
    )
    sql["score_asof_month"] = asof
    sql["score_asof_month_interval"] = asof
    sql["mom_balance"] = fx(
        f"""{CARD}select month_start, customer_id, cast(total_balance as double) as total_balance,
  cast(previous_month_balance as double) as previous_month_balance,
  cast(total_balance - previous_month_balance as double) as mom_balance_change,
  {_change(4)} from final""",
        *CARD_FX,
    )
    sql["credit_utilization"] = fx(
        f"{CARD}select month_start, customer_id, {_used(4)} from final", *CARD_FX
    )
    sql["risk_flag_months"] = fx(
        f"{CARD}select month_start, customer_id, {FLAG} as risk_flag from final", *CARD_FX
    )
    full = f"{CARD}select {_card_columns(4, 4)} from final"
    sql["customer_scorecard"] = fx(full, *CARD_FX)
    sql["scorecard_preview"] = fx(full + " order by month_start, customer_id limit 10", *CARD_FX)
    sql["scorecard_rank"] = fx(
        f"""{CARD}select month_start, customer_id, {FLAG} as risk_flag,
  row_number() over (order by month_start nulls last, customer_id nulls last) as row_number
from final""",
        *CARD_FX,
    )
    sql["scorecard_summary"] = fx(
        f"""{CARD}select month_start, count(*) as customers,
  count(*) filter (where {FLAG}) as risk_customers from final group by month_start""",
        *CARD_FX,
    )
    sql["customer_coverage"] = fx(
        """select count(*) as customers, count(h.customer_id) as with_account,
  count(*) - count(h.customer_id) as without_account
from fx_customers c left join (select distinct customer_id from fx_accounts) h
  on c.customer_id = h.customer_id""",
        "fx_customers",
        "fx_accounts",
    )
    sql["scorecard_month"] = fx(_month_card("1998-03-01"), *CARD_FX)
    sql["scorecard_upsert"] = (
        f"select * from ({fx(_month_card('1998-02-01'), *CARD_FX)}) a\nunion all\n"
        f"select * from ({fx(_month_card('1998-03-01'), *CARD_FX)}) b"
    )

    sql["city_list"] = fx(
        """select city, row_number() over (order by city) - 1 as city_index
from (select distinct city from fx_customers where city <> '') c""",
        "fx_customers",
    )
    sql["merchant_city"] = fx(
        f"with {(CITIES + ',' + _places(95)).strip()} select * from places", *FRAUD_FX
    )
    sql["rolling_count_1h"] = fx(
        f"""with {(EVENT_ROWS + "," + RATE).strip()}
select customer_id, epoch_us(txn_date) as txn_date, txn_count from rate""",
        *EVENT_FX,
    )
    sql["rolling_average_days"] = fx(
        f"""with {(EVENT_ROWS + "," + MEANS).strip()}
select customer_id, txn_id, cast(amount as double) as amount, window_rows,
  cast(window_sum as double) as window_sum from means""",
        *EVENT_FX,
    )
    for name in ("rolling_count_1h", "rolling_average_days"):
        sql[f"{name}_sliced"] = sql[name]
    fraud = f"with {FRAUD_CTES.strip()}"
    sql["fraud_high_frequency"] = fx(
        f"""{fraud} select customer_id, alert_date, max_transactions,
  epoch_us(first_trigger_at) as first_trigger_at from frequent""",
        *FRAUD_FX,
    )
    sql["fraud_multi_city"] = fx(f"{fraud} select * from spread", *FRAUD_FX)
    sql["fraud_high_amount"] = fx(
        f"""{fraud} select customer_id, alert_date, txn_id, epoch_us(txn_date) as txn_date,
  cast(amount as double) as amount, window_rows, cast(window_sum as double) as window_sum,
  avg_amount, ratio_to_avg from high""",
        *FRAUD_FX,
    )
    sql["fraud_alert_rows"] = fx(
        f"{fraud},{ALERTS} select * from alerts order by alert_date, customer_id, alert_type",
        *FRAUD_FX,
    )
    sql["fraud_alert_rows_by_rule"] = fx(f"{fraud},{ALERTS} select * from alerts", *FRAUD_FX)
    sql["alert_rank"] = fx(
        f"""{fraud},{ALERTS} select customer_id, alert_type, alert_date, txn_id,
  row_number() over (order by alert_date nulls last, customer_id nulls last,
    alert_type nulls last, txn_id nulls last) as row_number
from alerts""",
        *FRAUD_FX,
    )
    default_ctes = ",".join((EVENT_ROWS, RATE, CITIES, _places(95), HIGH_FREQUENCY, MULTI_CITY))
    default_ctes = default_ctes.replace("fx_txn_events", "bursts").replace("txn_count >= 3", "txn_count >= 5")
    sql["fraud_alerts_default"] = fx(
        f"""with bursts as (select * replace (make_timestamp(epoch_us(txn_date) // 24) as txn_date)
  from fx_txn_events), {default_ctes.strip()}
select customer_id, 'HIGH_FREQUENCY_1H' as alert_type, alert_date,
  cast(max_transactions as bigint) as max_transactions_in_1h, cast(null as bigint) as city_count,
  cast(null as varchar) as cities from frequent
union all
select customer_id, 'MULTI_CITY_1D', alert_date, null, city_count, cities from spread""",
        *FRAUD_FX,
    )
    default_means = MEANS.replace("interval 7 day", "interval 30 day")
    default_high = HIGH_AMOUNT.replace("interval 7 day", "interval 30 day").replace(
        "fx_txn_events", "fx_transactions"
    )
    default_rows = EVENT_ROWS.replace("fx_txn_events", "fx_transactions").replace(
        "fx_event_accounts", "fx_accounts"
    )
    sql["fraud_high_amount_default"] = fx(
        f"""with {",".join((default_rows, default_means, default_high)).strip()}
select customer_id, alert_date, txn_id, epoch_us(txn_date) as txn_date,
  cast(amount as double) as amount, window_rows, cast(window_sum as double) as window_sum,
  avg_amount, ratio_to_avg from high""",
        *SNAPSHOT_FX,
    )
    sql["alert_counts"] = fx(
        f"{fraud},{ALERTS} select alert_type, count(*) as alerts from alerts "
        "group by rollup (alert_type)",
        *FRAUD_FX,
    )

    event_columns = """event_id, user_id as customer_id, epoch_us(ts) as event_timestamp,
  event_type"""
    sql["events_clean"] = f"""select {event_columns}, props, cast(ts as date) as event_date
from events where {GOOD_EVENT}"""
    sql["events_quarantine"] = f"""select {event_columns}, props,
  'event_type is unknown' as reason, {_plain_time("ts")} as raw_event_timestamp
from events, (values (1), (2)) copies(n)
where not ({GOOD_EVENT})"""
    sql["events_quarantine_domains"] = f"""select * from (select {event_columns},
  screen_name, device_type, concat_ws('; ',
    case when not ({GOOD_EVENT}) then 'event_type is unknown' end,
    case when screen_name = 'Lobby' then 'screen_name is unknown' end,
    case when device_type = 'TV' then 'device_type is unknown' end) as reason
from (select *, case user_id % 10 when 9 then 'Lobby'
    else (['Dashboard', 'Transfer', 'Payment', 'Account', 'Profile', 'History', 'Card',
      'Investment'])[user_id % 10 + 1] end as screen_name,
  (['ANDROID', 'IOS', 'WEB', 'TV', null])[event_id % 5 + 1] as device_type from events) e) r
where reason <> ''"""
    sql["events_late"] = f"""with seen as (select max(ts) as last from events
  where event_id % 20 <> 0 and {GOOD_EVENT}),
late as (select {event_columns} from events, seen where event_id % 20 = 0 and {GOOD_EVENT}
  and epoch_us(ts) <= (epoch_us(last) // 1000 - 600000) * 1000)
select *, cast((select count(*) from late) as bigint) as dropped_by_watermark from late"""
    sql["events_tier_moves"] = """select case when date '2024-04-12' - cast(ts as date) <= 7 then 'hot'
    when date '2024-04-12' - cast(ts as date) <= 90 then 'warm' else 'cold' end as tier,
  cast(ts as date) as event_date, count(*) as events, cast(sum(event_id) as bigint) as ids
from events group by 1, 2"""
    sql["events_enriched"] = fx(
        f"""with context as (select customer_id, count(*) as account_count,
    cast(sum(balance) as double) as total_balance from fx_accounts group by customer_id)
select {event_columns.replace("event_id", "e.event_id")}, cast(ts as date) as event_date,
  c.segment, cast(k.risk_score as double) as risk_score, x.account_count, x.total_balance
from events e left join fx_customers c on e.user_id = c.customer_id
left join fx_kyc k on e.user_id = k.customer_id
left join context x on e.user_id = x.customer_id
where {GOOD_EVENT}""",
        "fx_customers",
        "fx_snapshots",
        "fx_accounts",
        "fx_kyc",
    )
    sql["events_tiered"] = """select case when date '2024-04-05' - cast(ts as date) <= 7 then 'hot'
    when date '2024-04-05' - cast(ts as date) <= 90 then 'warm' else 'cold' end as tier,
  cast(ts as date) as event_date, count(*) as events
from events group by 1, 2"""

    sql["transactions_clean"] = fx(
        f"""select {TXN_COLUMNS} from (
  select *, row_number() over (partition by txn_id order by txn_date desc,
    account_id asc nulls last, amount asc nulls last, channel asc nulls last,
    status asc nulls last, txn_type asc nulls last) as rn
  from fx_transactions where {GOOD_TXN}) t where rn = 1""",
        "fx_transactions",
    )
    sql["transactions_rejected"] = fx(
        f"""select {TXN_COLUMNS}, cast(amount as varchar) as raw_amount,
  {_plain_time("txn_date")} as raw_txn_date,
  'channel is unknown' as reason
from fx_transactions where not ({GOOD_TXN})""",
        "fx_transactions",
    )
    sql["lineage_trace"] = """with recursive edges as (
  select 'orders' as source_table, cast(o_orderkey as varchar) as source_column,
    'customer' as target_table, cast(o_custkey as varchar) as target_column from orders
  union all
  select 'customer', cast(c_custkey as varchar), 'nation', cast(c_nationkey as varchar)
  from customer
  union all
  select 'nation', cast(n_nationkey as varchar), 'region', cast(n_regionkey as varchar)
  from nation),
up as (
  select source_table as table_name, source_column as column_name, 1 as hop from edges
  where target_table = 'region' and target_column = '1'
  union all
  select e.source_table, e.source_column, u.hop + 1 from edges e
  join up u on e.target_table = u.table_name and e.target_column = u.column_name)
select table_name, column_name, min(hop) as hop from up group by 1, 2"""

    sql["rule_savings_fee"] = fx(
        f"""with {LATEST.strip()}
select month_start, count(*) as fee_accounts, count(*) * 10000 as fee_income
from latest where account_type = 'SAVINGS' and balance < 250000 group by month_start""",
        "fx_snapshots",
    )
    interest = _rounded(_cents("balance") + " * 5", "cast(120000 as hugeint)", 6)
    sql["rule_loan_interest"] = fx(
        f"""select account_id, customer_id, {interest} as monthly_interest
from fx_accounts where account_type = 'LOAN'""",
        "fx_accounts",
    )
    sql["rule_active_not_verified"] = fx(
        """select a.account_id, a.customer_id, k.kyc_status
from fx_accounts a join fx_kyc k on a.customer_id = k.customer_id
where k.kyc_status <> 'VERIFIED'""",
        "fx_accounts",
        "fx_kyc",
    )
    sql["rule_kyc_overdue"] = fx(
        """select customer_id, registration_date,
  cast(date '1995-03-01' - registration_date as int) as days_pending
from fx_kyc where kyc_status = 'PENDING' and date '1995-03-01' - registration_date > 30""",
        "fx_kyc",
    )
    sql["rule_rejected_with_txns"] = fx(
        """select a.customer_id, count(*) as txn_count
from fx_transactions t join fx_accounts a on t.account_id = a.account_id
join fx_kyc k on a.customer_id = k.customer_id
where k.kyc_status = 'REJECTED' group by a.customer_id""",
        *SNAPSHOT_FX,
        "fx_kyc",
    )
    sql["rule_score_jumps"] = fx(
        """select * from (
  select customer_id, score_date, credit_score,
    lag(credit_score) over (partition by customer_id order by score_date) as previous_score
  from (select customer_id, score_date,
    850 - cast(probability_of_default * 1000 as int) as credit_score from fx_scores) s) j
where abs(credit_score - previous_score) > 100""",
        "fx_scores",
    )
    sql["rule_risk_pd_corr"] = fx(
        """select round(corr(cast(k.risk_score as double),
    cast(s.probability_of_default as double)), 6) as correlation, count(*) as pairs
from fx_scores s join fx_kyc k on s.customer_id = k.customer_id""",
        "fx_scores",
        "fx_kyc",
    )
    sql["rule_balance_breaks"] = fx(
        """with net as (select account_id, cast(txn_date as date) as snapshot_date,
    sum(amount) as daily_net_amount from fx_transactions where status = 'COMPLETED' group by 1, 2),
paired as (select s.account_id, s.snapshot_date, s.balance,
    coalesce(n.daily_net_amount, 0) as daily_net_amount,
    lag(s.balance) over (partition by s.account_id order by s.snapshot_date) as previous_balance,
    lag(s.snapshot_date) over (partition by s.account_id order by s.snapshot_date)
      as previous_date
  from fx_snapshots s left join net n
    on s.account_id = n.account_id and s.snapshot_date = n.snapshot_date)
select account_id, snapshot_date, cast(balance as double) as balance,
  cast(daily_net_amount as double) as daily_net_amount,
  cast(previous_balance as double) as previous_balance, previous_date,
  cast(balance - (previous_balance + daily_net_amount) as double) as difference
from paired where previous_balance is not null
  and balance <> previous_balance + daily_net_amount""",
        "fx_snapshots",
        "fx_transactions",
    )
    sql["rule_balance_breaks_days"] = (
        f"select * from ({sql['rule_balance_breaks']}) b where snapshot_date - previous_date = 1"
    )
    sql["rule_duplicate_customers"] = fx(
        "select nik, count(*) as customers from fx_kyc group by nik having count(*) > 1", "fx_kyc"
    )
    sql["rule_duplicate_groups"] = """with recursive keyed as (select customer_id,
    case when customer_id % 5 < 4 then customer_id // 3 end as nik,
    case when customer_id % 7 < 5 then (customer_id + 1) // 3 end as phone from (select c_custkey as customer_id from customer) c),
links as (select a.customer_id as a, b.customer_id as b from keyed a join keyed b
  on a.nik = b.nik where a.customer_id <> b.customer_id
  union select a.customer_id, b.customer_id from keyed a join keyed b
  on a.phone = b.phone where a.customer_id <> b.customer_id),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select a as customer_id, min(b) as group_id from reach group by a"""
    sql["rule_mask_pii"] = fx(
        """select customer_id, repeat('*', length(nik)) as nik,
  repeat('*', length(phone) - 4) || right(phone, 4) as phone from fx_kyc""",
        "fx_kyc",
    )
    sql["rule_sign_violations"] = fx(
        """select txn_type, count(*) as txn_count,
  count(*) filter (where (txn_type in ('CREDIT', 'TRANSFER_IN') and amount < 0)
    or (txn_type in ('DEBIT', 'TRANSFER_OUT', 'FEE') and amount > 0)) as violations
from fx_transactions group by txn_type""",
        "fx_transactions",
    )
    sql["rule_score_features"] = """select event_id,
  cast(json_extract_string(props, '$.k') as int) as k from events"""
    sql["rule_feature_types"] = """with cut as (select
    case when event_id % 13 = 0 then substr(props, 1, 4) else props end as p from events),
keyed as (select unnest(json_keys(p)) as feature, p from cut where json_valid(p))
select feature, 'BIGINT' as type, count(*) as "values" from keyed group by 1, 2
union all select null, null, count(*) from cut where not json_valid(p)"""
    return sql
