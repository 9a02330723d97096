"""Text expressions: blank test, hash bucket, masks, sorted sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_blank(column: str | Column) -> Column:
    """Neither NULL nor empty."""
    value = _col(column)
    return value.isNotNull() & (value != "")


def hash_number(column: str | Column) -> Column:
    """First eight hex digits of the MD5 of the text, as a number."""
    digest = F.md5(_col(column).cast("string").cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sorted_set(column: str | Column) -> Column:
    """Aggregate: the distinct values of a group in ascending order."""
    return F.array_sort(F.collect_set(_col(column)))


def mask_all(column: str | Column) -> Column:
    """Every character replaced by ``*``, the length kept."""
    return F.regexp_replace(_col(column), ".", "*")


def mask_but_last(column: str | Column, keep: int = 4) -> Column:
    """Only the last ``keep`` characters stay readable."""
    return F.regexp_replace(_col(column), f".(?=.{{{keep}}})", "*")


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
