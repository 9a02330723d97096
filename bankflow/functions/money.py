"""Money, ratio and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money type and the three risk thresholds.
MONEY = "decimal(15,2)"
WIDE_MONEY = "decimal(20,2)"
UTILISATION_LIMIT = "0.80"
DEFAULT_PROBABILITY_LIMIT = "0.30"
BALANCE_DROP_LIMIT = "-0.30"


def money(column: str | Column) -> Column:
    """Exact money; a value that does not fit raises under ANSI."""
    return _col(column).cast(MONEY)


def wide_money(column: str | Column) -> Column:
    """Money of the report tables, wide enough for sums over customers."""
    return _col(column).cast(WIDE_MONEY)


def try_money(column: str | Column) -> Column:
    """Money, or NULL for text that is no number (for quarantine paths)."""
    return _col(column).try_cast(MONEY)


def null_to_zero(column: str | Column) -> Column:
    return F.coalesce(_col(column), F.lit(0))


def delta(now: str | Column, before: str | Column) -> Column:
    return _col(now) - _col(before)


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / |denominator|``, NULL when the denominator is zero or NULL."""
    return _col(numerator) / F.nullif(F.abs(_col(denominator)), F.lit(0))


def change_ratio(now: str | Column, before: str | Column) -> Column:
    """Relative change against the size of the earlier value."""
    return safe_ratio(delta(now, before), before)


def decimal_ratio(total: str | Column, count: str | Column) -> Column:
    """Mean from an exact sum and a count with 15 fractional digits, NULL for no rows."""
    return _col(total).cast("decimal(25,2)") / F.nullif(_col(count), F.lit(0)).cast("decimal(12,0)")


def rounded_ratio(numerator: str | Column, denominator: str | Column, scale: int) -> Column:
    """Quotient of two non-negative decimals rounded half up once, NULL for a zero denominator.

    Wide decimals leave a plain division only a few digits, and rounding those again can be off by
    one in the last place. Here the remainder is taken off first, so the division comes out even.
    """
    unit = 10**scale
    twice = F.nullif(_col(denominator), F.lit(0)) * 2
    shifted = _col(numerator) * (2 * unit) + _col(denominator)
    whole = ((shifted - shifted % twice) / twice).cast("decimal(30,0)")
    return (whole / F.lit(unit)).cast(f"decimal(30,{scale})")


def utilisation(balance: str | Column, limit: str | Column, guard: str = "positive") -> Column:
    """Card balance over card limit.

    ``guard='positive'`` (full scorecard) gives 0 unless the limit is above zero;
    ``guard='nonzero'`` (monthly load) gives 0 for a zero or missing limit and lets a negative
    limit through. The two differ only for a negative limit.
    """
    balance, limit = _col(balance), _col(limit)
    if guard == "positive":
        usable = limit > 0
    elif guard == "nonzero":
        usable = limit != 0
    else:
        raise ValueError(f"unknown utilisation guard {guard!r}")
    return F.coalesce(F.when(usable, balance / F.nullif(limit, F.lit(0))), F.lit(0))


def risk_flag(
    credit_utilisation: str | Column, probability: str | Column, change: str | Column
) -> Column:
    """True when any threshold is strictly crossed; a NULL input never raises the flag."""
    crossed = (
        (_col(credit_utilisation) > _decimal(UTILISATION_LIMIT))
        | (_col(probability) > _decimal(DEFAULT_PROBABILITY_LIMIT))
        | (_col(change) < _decimal(BALANCE_DROP_LIMIT))
    )
    return F.coalesce(crossed, F.lit(False))


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(3,2)")


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
