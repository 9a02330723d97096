"""Business and regulatory rules stated for the banking data set."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.functions import mask_all, mask_but_last, money, month_of
from bankflow.operators.activity import with_customer
from bankflow.operators.balances import latest_per_month
from bankflow.operators.groups import connected_groups
from bankflow.operators.previous import previous_row
from bankflow.schemas import INFLOW_TYPES, OUTFLOW_TYPES

# Fee in rupiah and the balance below which it is due.
SAVINGS_FEE = 10_000
SAVINGS_FEE_BELOW = 1_000_000


def savings_fee(
    snapshots: DataFrame, fee: int = SAVINGS_FEE, below: int = SAVINGS_FEE_BELOW
) -> DataFrame:
    """Fee income per month from savings accounts whose month-end balance is under the limit."""
    return (
        latest_per_month(snapshots.filter(F.col("account_type") == "SAVINGS"))
        .filter(F.col("balance") < below)
        .groupBy("month_start")
        .agg(
            F.count("*").alias("fee_accounts"),
            (F.count("*") * F.lit(fee)).alias("fee_income"),
        )
    )


def loan_interest(accounts: DataFrame) -> DataFrame:
    """One month's interest per loan: balance times yearly rate over twelve."""
    return accounts.filter(F.col("account_type") == "LOAN").select(
        "account_id",
        "customer_id",
        (money("balance") * F.col("interest_rate").cast("decimal(5,4)") / F.lit(12)).alias(
            "monthly_interest"
        ),
    )


def active_not_verified(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Active accounts whose customer is not verified."""
    unverified = customers.filter(F.col("kyc_status") != "VERIFIED")
    return accounts.filter(F.col("status") == "ACTIVE").select("account_id", "customer_id").join(
        unverified.select("customer_id", "kyc_status"), "customer_id"
    )


def kyc_overdue(customers: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Customers pending for more than ``days`` since registration."""
    waited = F.datediff(F.lit(as_of), F.col("registration_date"))
    return (
        customers.filter(F.col("kyc_status") == "PENDING")
        .select("customer_id", "registration_date", waited.alias("days_pending"))
        .filter(F.col("days_pending") > days)
    )


def rejected_with_txns(
    transactions: DataFrame, accounts: DataFrame, customers: DataFrame
) -> DataFrame:
    """Rejected customers that have transactions, with how many."""
    rejected = customers.filter(F.col("kyc_status") == "REJECTED").select("customer_id")
    per_account = transactions.groupBy("account_id").agg(F.count("*").alias("_rows"))
    return (
        with_customer(per_account, accounts)
        .join(rejected, "customer_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.sum("_rows").alias("txn_count"))
    )


def score_jumps(scores: DataFrame, limit: int = 100) -> DataFrame:
    """Assessments more than ``limit`` points away from the customer's one before."""
    order = [c for c in ("score_date", "score_id") if c in scores.columns]
    paired = previous_row(
        scores.select("customer_id", *order, "credit_score"),
        "customer_id", order, ["credit_score"], month_of("score_date"),
    )
    return paired.select(
        "customer_id", "score_date", "credit_score",
        F.col("previous_credit_score").alias("previous_score"),
    ).filter(F.abs(F.col("credit_score") - F.col("previous_score")) > limit)


def risk_pd_corr(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Correlation of the customers' risk score with their probabilities of default."""
    return scores.select("customer_id", "probability_of_default").join(
        customers.select("customer_id", "risk_score"), "customer_id"
    ).agg(
        F.corr(
            F.col("risk_score").cast("double"), F.col("probability_of_default").cast("double")
        ).alias("correlation"),
        F.count("*").alias("pairs"),
    )


def balance_breaks(snapshots: DataFrame, consecutive_days: bool = True) -> DataFrame:
    """Snapshots where the balance before plus the day's net amount is not the balance.

    With ``consecutive_days`` only pairs of neighbouring dates count, since the net amount covers
    one day.
    """
    paired = previous_row(
        snapshots.select("account_id", "snapshot_date", "balance", "daily_net_amount"),
        "account_id", ["snapshot_date"], ["balance", "snapshot_date"], month_of("snapshot_date"),
    ).withColumnRenamed("previous_snapshot_date", "previous_date").filter(
        F.col("previous_balance").isNotNull()
    )
    if consecutive_days:
        paired = paired.filter(F.datediff("snapshot_date", "previous_date") == 1)
    expected = F.col("previous_balance") + F.coalesce("daily_net_amount", F.lit(0))
    return paired.withColumn("difference", F.col("balance") - expected).filter("difference <> 0")


def duplicate_customers(customers: DataFrame, key: str) -> DataFrame:
    """Values of an identity column that several customers share."""
    return (
        customers.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("customers"))
        .filter("customers > 1")
    )


def duplicate_groups(customers: DataFrame, keys: tuple[str, ...] = ("nik", "phone")) -> DataFrame:
    """Customers that share any of the identity columns, directly or through others, with their group.

    Empty text identifies nobody, like NULL.
    """
    cleaned = customers.select(
        "customer_id", *[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys]
    )
    return connected_groups(cleaned, "customer_id", list(keys))


def mask_pii(customers: DataFrame) -> DataFrame:
    """National id hidden, phone readable in its last four digits only."""
    return customers.withColumn("nik", mask_all("nik")).withColumn(
        "phone", mask_but_last("phone", 4)
    )


def sign_violations(transactions: DataFrame) -> DataFrame:
    """Per type: rows, and rows whose amount has the wrong sign. Payments have no stated sign."""
    wrong = (F.col("txn_type").isin(*INFLOW_TYPES) & (F.col("amount") < 0)) | (
        F.col("txn_type").isin(*OUTFLOW_TYPES) & (F.col("amount") > 0)
    )
    return transactions.groupBy("txn_type").agg(
        F.count("*").alias("txn_count"), F.count_if(wrong).alias("violations")
    )


def score_features(scores: DataFrame, schema: str, column: str = "features_used") -> DataFrame:
    """The JSON column as typed columns; broken JSON gives NULLs."""
    return scores.withColumn("_features", F.from_json(column, schema)).select(
        *[c for c in scores.columns if c != column], "_features.*"
    )


def feature_types(scores: DataFrame, column: str = "features_used") -> DataFrame:
    """Every key of the JSON objects with the types of its values and their number; no schema is needed.

    Types are those of the VARIANT type (a whole number is a BIGINT whatever its size). JSON that cannot be read
    and values that are no objects count under a NULL key with the type of the whole value, NULL if unreadable.
    """
    parsed = scores.select(F.try_parse_json(F.col(column)).alias("_v"))
    # The table function gives no row for a value without members.
    members = parsed.lateralJoin(
        parsed.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())
    )
    whole = F.when(F.col("key").isNull() & F.col("_v").isNotNull(), F.col("_v"))
    kind = F.schema_of_variant(F.coalesce(F.when(F.col("key").isNotNull(), F.col("value")), whole))
    return (
        members.filter("key is not null or pos is null or pos = 0")
        .groupBy(F.col("key").alias("feature"), kind.alias("type"))
        .agg(F.count("*").alias("values"))
    )
