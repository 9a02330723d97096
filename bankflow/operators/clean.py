"""Batch cleaning of raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankflow.functions import try_money
from bankflow.schemas import CHANNELS, TXN_STATUSES, TXN_TYPES

RAW_COLUMNS = ("raw_amount", "raw_txn_date")


def validate_transactions(raw: DataFrame) -> DataFrame:
    """Typed columns plus ``reason``: NULL for a good row, else the failed checks.

    Bad text becomes NULL through ``try_cast`` and is reported, so one row cannot stop the job; the
    values as they came stay in ``raw_amount`` and ``raw_txn_date``, which only rejected rows keep.
    """
    typed = raw.withColumns(
        {c: F.col(c.removeprefix("raw_")).cast("string") for c in RAW_COLUMNS}
    ).withColumns(
        {"amount": try_money("amount"), "txn_date": F.col("txn_date").try_cast("timestamp_ntz")}
    )
    failures = [
        _failure(F.col("txn_id").isNull(), "txn_id is missing"),
        _failure(F.col("account_id").isNull(), "account_id is missing"),
        _failure(F.col("txn_date").isNull(), "txn_date is missing or unreadable"),
        _failure(F.col("amount").isNull(), "amount is missing or unreadable"),
        _failure(_outside("txn_type", TXN_TYPES), "txn_type is unknown"),
        _failure(_outside("channel", CHANNELS), "channel is unknown"),
        _failure(_outside("status", TXN_STATUSES), "status is unknown"),
    ]
    return typed.withColumn("reason", F.nullif(F.concat_ws("; ", *failures), F.lit("")))


def clean_transactions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, one per ``txn_id``, and rejected rows with their reason.

    Among copies the latest date wins, then the other columns in order, so the choice does not
    depend on file order. The ranking keeps one row per id in each map task, which also removes a
    huge group of copies before the shuffle.
    """
    checked = validate_transactions(raw)
    rejected = checked.filter(F.col("reason").isNotNull())
    valid = checked.filter(F.col("reason").isNull()).drop("reason", *RAW_COLUMNS)
    rest = [c for c in valid.columns if c not in ("txn_id", "txn_date")]
    pick = Window.partitionBy("txn_id").orderBy(
        F.desc("txn_date"), *[F.asc_nulls_last(c) for c in sorted(rest)]
    )
    unique = valid.withColumn("_rn", F.row_number().over(pick)).filter("_rn = 1").drop("_rn")
    return unique, rejected


def _outside(column: str, domain: tuple[str, ...]):
    return F.coalesce(~F.col(column).isin(*domain), F.lit(True))


def _failure(condition, text: str):
    return F.when(condition, F.lit(text))
