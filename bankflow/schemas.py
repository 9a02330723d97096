"""Column contracts of the tables, as Spark DDL strings."""

# Table layouts and value domains of the banking data set.
CUSTOMERS = (
    "customer_id string, full_name string, nik string, phone string, email string, city string, "
    "province string, registration_date date, kyc_status string, risk_score double, segment string"
)
ACCOUNTS = (
    "account_id string, customer_id string, account_type string, product_name string, "
    "opened_date date, status string, balance decimal(15,2), credit_limit decimal(15,2), "
    "interest_rate decimal(5,4)"
)
TRANSACTIONS = (
    "txn_id string, account_id string, txn_date timestamp_ntz, txn_type string, "
    "amount decimal(15,2), merchant_category string, channel string, reference_id string, "
    "status string"
)
CREDIT_SCORES = (
    "score_id string, customer_id string, score_date date, model_version string, "
    "credit_score int, probability_of_default decimal(5,4), features_used string"
)
TRANSACTION_LOCATIONS = "txn_id string, merchant_city string, location_source string"
APP_EVENTS = (
    "event_id string, customer_id string, event_timestamp timestamp, event_type string, "
    "screen_name string, session_id string, device_type string, app_version string"
)
SNAPSHOTS = (
    "snapshot_date date, account_id string, customer_id string, account_type string, "
    "product_name string, opened_date date, status string, balance decimal(15,2), "
    "credit_limit decimal(15,2), interest_rate decimal(5,4), daily_net_amount decimal(15,2), "
    "daily_txn_count bigint"
)
SCORECARD = (
    "month_start date, customer_id string, total_balance decimal(20,2), "
    "previous_month_balance decimal(20,2), mom_balance_change decimal(20,2), "
    "mom_balance_change_pct decimal(18,6), credit_utilization decimal(18,6), "
    "probability_of_default decimal(5,4), debit_count bigint, credit_count bigint, "
    "transfer_in_count bigint, transfer_out_count bigint, payment_count bigint, fee_count bigint, "
    "avg_mobile_app_amount decimal(20,2), avg_web_amount decimal(20,2), "
    "avg_qris_amount decimal(20,2), avg_atm_network_amount decimal(20,2), "
    "avg_auto_debit_amount decimal(20,2), risk_flag boolean, refreshed_at timestamp"
)
ALERTS = "customer_id string, alert_type string, alert_date date, details_json string"
PIPELINE_RUNS = (
    "run_id string, pipeline_name string, snapshot_date date, source string, target string, "
    "row_count bigint, dq_status string, job_status string, start_time timestamp, "
    "end_time timestamp"
)
COLUMN_LINEAGE = (
    "source_system string, source_table string, source_column string, target_table string, "
    "target_column string, pipeline_name string, run_id string"
)

TXN_TYPES = ("DEBIT", "CREDIT", "TRANSFER_IN", "TRANSFER_OUT", "PAYMENT", "FEE")
CHANNELS = ("MOBILE_APP", "WEB", "QRIS", "ATM_NETWORK", "AUTO_DEBIT")
TXN_STATUSES = ("COMPLETED", "PENDING", "FAILED", "REVERSED")
INFLOW_TYPES = ("CREDIT", "TRANSFER_IN")
OUTFLOW_TYPES = ("DEBIT", "TRANSFER_OUT", "FEE")
EVENT_TYPES = (
    "screen_view", "button_click", "transaction_initiated", "login", "logout", "transfer_start",
    "payment_complete",
)
SCREENS = (
    "Dashboard", "Transfer", "Payment", "Account", "Profile", "History", "Card", "Investment",
)
DEVICES = ("ANDROID", "IOS", "WEB")


def column_names(ddl: str) -> list[str]:
    """Names of a DDL string in order."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names
