"""Date and time expressions. Timestamps carry no zone: run sessions in UTC."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: str | date) -> date:
    """Turn ``YYYY-MM-DD`` into a date; anything else raises ``ValueError`` before a job starts."""
    if isinstance(text, datetime):
        return text.date()
    if isinstance(text, date):
        return text
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"expected a date as YYYY-MM-DD, got {text!r}") from None


def parse_month(text: str | date) -> date:
    """Like :func:`parse_day`, and the date must be the first of a month."""
    day = parse_day(text)
    if day.day != 1:
        raise ValueError(f"a run month is the first day of a month, got {day}")
    return day


def shift_month(month: date, by: int) -> date:
    """First of the month ``by`` months away from the first-of-month ``month``."""
    index = month.year * 12 + month.month - 1 + by
    return date(index // 12, index % 12 + 1, 1)


def month_of(column: str | Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(F.to_date(_col(column)), "month")


def next_month(column: str | Column) -> Column:
    return F.add_months(_col(column), 1)


def in_day(column: str | Column, day: str | date) -> Column:
    """``day <= column < day + 1``.

    The bounds are date literals: Spark folds them to the column's own type, so the comparison
    stays on the bare column and reaches the Parquet or JDBC source.
    """
    start = parse_day(day)
    return between_days(column, start, start + timedelta(days=1))


def between_days(column: str | Column, start: date, end: date) -> Column:
    """Half-open range ``start <= column < end`` on date bounds."""
    value = _col(column)
    return (value >= F.lit(start)) & (value < F.lit(end))


def month_range(column: str | Column, run_month: str | date, back: int = 1) -> Column:
    """Rows of the run month and the ``back`` months before it, as a pushable range."""
    run = parse_month(run_month)
    return between_days(column, shift_month(run, -back), shift_month(run, 1))


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch, the order key of the rolling windows."""
    return F.unix_micros(_col(column).cast("timestamp"))


def iso_text(column: str | Column) -> Column:
    """ISO text of a timestamp with a ``T`` and no trailing zeros in the fraction."""
    return F.translate(_col(column).cast("string"), " ", "T")


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
