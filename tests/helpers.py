"""Small helpers for hand-made rows."""

from datetime import date, datetime
from decimal import Decimal


def rows(df, *order):
    """Rows as tuples, sorted by their text."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def d(text):
    return date.fromisoformat(text)


def ts(text):
    return datetime.fromisoformat(text)


def dec(text):
    return Decimal(text)


def plan_of(df):
    return df._jdf.queryExecution().toString()
